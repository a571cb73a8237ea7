"""Alignment of tokens against whole-text encoding and plain loops."""

import collections
import random

import numpy as np
import pytest

from regweave.llm import alignment
from regweave.llm.alignment import FOLDER, Tokenizers, align_tokenizers, coalesce, overlaps

A, B = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
ODD = ["  two  spaces ", "<|endoftext|> and <s> </s>", "ﬁ ① Ａ é́", "a▁b", "tab\tnew\nline \xa0x", "\x00a", " ", "\n", "x" * 5000,
       "日本語のテキスト です", "🙂 emoji🙂🙂", "it's we'll 3.14 —— ...", "one.\n\n  Two wide", "<0x41> <unk>", "\u0085 next", "\x1c gap \x1c"]


def brute(rows):
    both = Tokenizers(A, B)
    found, counts = {}, collections.Counter()
    for k, text in rows:
        a = b = []
        if text:
            raw = (" " + text).encode()
            a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
            if b"".join(both.a_bytes[i] for i in a) != raw or b"".join(both.b_bytes[i] for i in b) != raw:
                a = b = []
        spans = []
        for ids, table in ((a, both.a_bytes), (b, both.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for hi in ends:
            groups.append([[t for s, e, t in own if lo <= s and e <= hi] for own in spans])
            lo = hi
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(set(links))
        found[k] = (len(a), len(b), groups, links)
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return {k: (a, b, len(g), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
                ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for k, (a, b, g, links) in found.items()}


def rows_of(out):
    return {r.doc_id: tuple(r)[1:] for r in out.collect()}


def test_vocabulary_bytes():
    both = Tokenizers(A, B)
    assert len(both.a_bytes) == 50257 and both.a_bytes[50256] == b"<|endoftext|>" and len(set(both.a_bytes)) == 50257
    assert len(alignment.byte_alphabet()) == 256 and both.b_bytes[both.b.piece_to_id("<0x0A>")] == b"\n"


@pytest.mark.parametrize("seed", range(3))
def test_parts_are_encoded_as_whole_texts(seed, monkeypatch):
    monkeypatch.setattr(alignment, "PART_CHARS", 1)
    r, both = random.Random(seed), Tokenizers(A, B)
    bits = [" ", " ", "  ", "\n", "\t", "\xa0", "a", "The", "is", "'s", "12", ".", "é", " ", "▁", "日", "\x1c", "\x85", "x y", "́", "Ω", "१", "aaaaaaa"]
    for text in ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(400)]:
        a, b = both.document(text)
        whole = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        raw = (" " + text).encode()
        same = b"".join(both.a_bytes[i] for i in whole[0]) == raw == b"".join(both.b_bytes[i] for i in whole[1])
        assert (a, b) == (whole if same else ([], [])), repr(text)


def test_both_encoders_of_a_agree(documents):
    both, r = Tokenizers(A, B), random.Random(9)
    assert both.by_least_id is not None
    texts = [x.text for x in documents.collect() if x.text]
    texts += ["".join(r.choice("aaabtheinrs 'dl\n  .,-019éßçÀ—’日の한") for _ in range(r.randint(1, 200))) for _ in range(1500)]
    for text in texts:
        assert both.encode_a(text) == both.a.encode(text, add_special_tokens=False).ids, repr(text)


def test_coalesce():
    a, b = np.array([[0, 2], [2, 5], [5, 9], [9, 10]]).T, np.array([[0, 3], [3, 5], [5, 6], [6, 9], [9, 10]]).T
    groups = coalesce(*a, *b)
    assert [g.tolist() for g in groups] == [[0, 0, 1, 2], [0, 0, 1, 1, 2]]
    assert list(zip(*(x.tolist() for x in overlaps(*a, *b, *groups)))) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("block, pairs", [(1 << 20, 2_000_000), (500, 300)])
def test_against_loops(spark, documents, monkeypatch, block, pairs):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more).selectExpr("*", "1 as id", "2 as a", "text as block").repartition(4)
    assert rows_of(align_tokenizers(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_documents, no_documents):
    assert align_tokenizers(no_documents).count() == 0
    out = align_tokenizers(odd_documents).collect()
    assert len(out) == 7 and sorted(r.n_a for r in out)[:2] == [0, 0]
    assert all(r.n_best == r.n_links == r.count_sum == 0 and r.alignment == "" for r in out if not r.n_a)
