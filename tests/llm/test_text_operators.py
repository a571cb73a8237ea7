"""Decontamination, mixing, chat formatting, language and quality."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from regweave.llm import decontaminate, language
from regweave.llm.chat import format_conversations, loss_text
from regweave.llm.decontaminate import benchmark_hits, without_hits
from regweave.llm.language import UNKNOWN, calibrate, identify_languages
from regweave.llm.mixing import fill, mix_sources, targets
from regweave.llm.quality import ABSTAIN, BAD, GOOD, TOXIC_TERMS, classify, estimate, filter_quality, signals, votes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute_hits(docs, items, length=10):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k:k + n])]
        out[d] = (len(w), sorted(hit), sorted(ids))
    return out


@pytest.fixture(scope="module")
def items(spark, documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    a = " ".join(text[9].upper().split()[5:40])
    b = "!!! " + " -- ".join(text[10].split()[:6])
    return spark.createDataFrame([(1, a), (2, b), (30, a + " tail"), (4, None), (5, "..."), (6, "one")],
                                 "item_id long, text string")


@pytest.mark.parametrize("most", [16 << 20, 50])
def test_hits_against_brute_force(documents, items, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_BYTES", most)  # 50: several automatons
    expected = brute_hits([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = benchmark_hits(documents, items).collect()
    assert {r.doc_id: (r.n_words, r.hits, r["items"]) for r in got} == expected
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in got:
        inside = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text[r.doc_id][s.from_char:s.to_char])) for s in r.spans)
        assert inside == len(r.hits)
    clean = without_hits(documents, items)
    assert clean.columns == documents.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, v in expected.items() if not v[1]}


def test_hits_of_odd_rows(odd_documents, no_documents, items):
    none = items.filter("item_id < 0")
    assert [r.hits for r in benchmark_hits(odd_documents, none).collect()] == [[]] * 7
    assert benchmark_hits(no_documents, items).count() == 0
    assert without_hits(odd_documents, items).count() == 5  # "one two three" twice holds an item of one word


def test_targets():
    assert targets([("a", 100), ("b", 100), ("c", 100)]) == [200.0, pytest.approx(250 * 2 / 3), pytest.approx(250 / 3)]
    assert targets([("a", 0), ("b", 10)]) == [0.0, 15.0] and targets([]) == []


def test_fill_is_exact_where_it_can_be():
    r = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.unique(r.integers(1, 60, 6))
        counts, budget = r.integers(1, 4, len(lengths)), int(r.integers(0, 250))
        take = fill(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_mixing(documents, odd_documents, no_documents):
    got = mix_sources(documents).collect()
    assert len(got) == documents.count()
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.times <= 2
        taken[r.source] += r["size"] * r.times
        size[r.source] += r["size"]
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)
    again = mix_sources(documents.repartition(3)).collect()
    assert sorted((r.doc_id, r.times) for r in got) == sorted((r.doc_id, r.times) for r in again)
    assert mix_sources(odd_documents).count() == 7 and mix_sources(no_documents).count() == 0


CONTROL = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\/s>", "[/INST", "]", "[[/INST]]", "<<s>s>", "\\", "<\\\\/s>", "a\nb", "[\\INST]", "", "é</s>"]


def test_round_trip(spark):
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(
        [(CONTROL[(c * 5 + i) % len(CONTROL)] if i % 4 == 3 else ["user", "assistant", "system"][i % 3], x) for i, x in enumerate(CONTROL)])]
    rows += [(9, 1, "user", None), (9, 0, None, "first"), (9, 1, "user", None), (None, None, "assistant", "x"), (10, 0, "user", "</s>")]
    got = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn(
        "loss", loss_text(F.col("turns"))).collect()
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert {g.conv_id for g in got} == set(by)
    for g in got:
        source = sorted(by[g.conv_id])
        assert g.exact and [tuple(t) for t in g.turns] == [(r, x) for _, r, x in source]
        assert g.loss == "".join(x for _, r, x in source if r == "assistant")
        assert g.formatted.count("</s>") == len(source)


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain <b> [x]"), (1, 1, "user", "</s>")]
    got = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.formatted == "<s>[INST]user[/INST]plain <b> [x]</s><s>[INST]user[/INST]<\\/s></s>"
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_languages(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    rows = docs.collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert len(held) > 20 and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    blind = identify_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in blind.collect()} == {UNKNOWN}
    odd = identify_languages(odd_documents).collect()
    assert len(odd) == 7 and sorted(r.lang_pred for r in odd if r.score == 0) == [UNKNOWN] * 2
    assert identify_languages(no_documents).count() == 0


def kneser_ney(weighted, order):
    """Probability function of one language by plain dictionaries; ``weighted`` are (word, count)."""
    count, before = collections.Counter(), collections.defaultdict(set)
    for w, k in weighted:
        w = f" {w} "
        for i in range(1, len(w)):
            for n in range(1, min(order, i + 1) + 1):
                count[w[i - n + 1:i + 1]] += k
                if n > 1:
                    before[w[i - n + 2:i + 1]].add(w[i - n + 1])
    c = {g: k if len(g) == order else len(before[g]) or k for g, k in count.items()}
    total, kinds, by_size = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for g, k in c.items():
        key = (len(g), g[:-1])
        total[key] += k
        kinds[key] += 1
        by_size[len(g)][k] += 1
    d = {n: x[1] / (x[1] + 2 * x[2]) if x[1] and x[2] else 0.5 for n, x in by_size.items()}

    def p(g, letters):
        n, context = len(g), g[:-1]
        if n == 0:
            return 1 / (letters + 1)
        if n == 1 and g not in c:
            return 1e-7
        if (n, context) not in total:
            return p(g[1:], letters)
        t = total[n, context]
        return max(c.get(g, 0) - d[n], 0) / t + d[n] * kinds[n, context] / t * p(g[1:], letters)
    return p, {g for g in c if len(g) == 1}


def test_kneser_ney(spark, monkeypatch):
    """Entropies equal those of a plain dictionary model, with several blocks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).repartition(5).cache()
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    words = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t, _ in rows}
    expected = {}
    for order in (1, 3):
        models, letters = {}, set()
        for lang in {x for _, _, x in rows if x}:
            known = collections.Counter(w for i, _, x in rows if x == lang and zlib.crc32(str(i).encode()) % 5 for w in words[i])
            models[lang], own = kneser_ney(known.items(), order)
            letters |= own
        for i, own in words.items():
            if own:
                n = sum(len(w) + 1 for w in own)
                expected[order, i] = min(-sum(
                    np.log(p(f" {w} "[max(0, k - order + 1):k + 1], len(letters)))
                    for w in own for k in range(1, len(w) + 2)) / n for p in models.values())
    for order, size in ((1, 8 << 20), (3, 1)):
        monkeypatch.setattr(language, "BLOCK_BYTES", size)
        got = {r.doc_id: r.entropy for r in identify_languages(docs, order, sample=0).collect()}
        assert {i: e for i, e in got.items() if e is not None} == pytest.approx(
            {i: e for (o, i), e in expected.items() if o == order}, abs=1e-5)


def test_calibration():
    """Scores stay below one without errors, and fall with the share of errors."""
    r = np.random.default_rng(1)
    lang = r.integers(0, 3, 500)
    entropy = np.full((500, 3), 3.0)
    entropy[np.arange(500), lang] = 2.0
    sharp, limit = calibrate(entropy, lang)
    assert 0.9 < limit < 1
    wrong = np.where(np.arange(500) % 5 == 0, (lang + 1) % 3, lang)
    assert calibrate(entropy, wrong)[0] > sharp
    assert calibrate(np.zeros((0, 3)), np.zeros(0, np.int64)) == (1.0, 0.0)


def test_estimate():
    patterns = {"0" * 8 + "0": 900, "2" + "0" * 7 + "0": 5, "1" + "0" * 7 + "1": 40, "1" + "0" * 7 + "0": 60,
                "0" * 7 + "2" + "2": 300, "0" * 7 + "2" + "0": 500}
    posterior, right = estimate(patterns)
    assert posterior["1" + "0" * 7 + "0"] < 0.1 and posterior["0" * 7 + "2" + "0"] > 0.85 and posterior["0" * 9] > 0.5
    assert right[0, BAD - 1] > 0.9 and right[7, GOOD - 1] > 0.85
    assert estimate({})[0] == {}


def test_quality(spark, odd_documents, no_documents):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id: r.quality == 1 and not r.toxic for r in labels.collect()}
    got = {r.doc_id: r.keep for r in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    kept = [got[k] for k, v in good.items() if v]
    gone = [not got[k] for k, v in good.items() if not v]
    assert sum(kept) >= 0.97 * len(kept) and sum(gone) >= 0.8 * len(gone)
    filtered = filter_quality(docs, labels)
    assert filtered.columns == docs.columns and {r.doc_id for r in filtered.collect()} == {k for k, v in got.items() if v}
    odd = classify(odd_documents).collect()
    assert len(odd) == 7 and not any(r.keep for r in odd if r.votes[6] == str(BAD)) and sum(r.votes[6] == str(BAD) for r in odd) == 2
    assert classify(no_documents).count() == 0


def test_one_toxic_word_does_not_reject_a_long_text(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    clean = docs.join(labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id"), "doc_id", "left_semi")
    long = clean.filter(F.size(F.split("text", " ")) > 600).orderBy("doc_id").limit(5)
    added = long.withColumn("doc_id", F.col("doc_id") + 10**9).withColumn("text", F.concat("text", F.lit(" trash")))
    got = classify(docs.unionByName(added), labels).filter(F.col("doc_id") >= 10**9).collect()
    assert len(got) > 1 and all(r.keep and r.votes[5] == str(ABSTAIN) for r in got)
    terms = (frozenset(t.encode() for t in TOXIC_TERMS), frozenset(), ())
    prose = " ".join(f"word{i}" for i in range(40))
    assert votes(signals(f"{prose} you stupid, stupid idiot", terms)[0])[5] == str(BAD)
    assert votes(signals(" ".join([prose, "stupid idiot"] * 50), terms)[0])[5] == str(BAD)  # however long
