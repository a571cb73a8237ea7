"""Repeated strings and word windows against brute force."""

import collections
import random

import numpy as np
import pytest

from regweave.llm import suffix
from regweave.llm.substring import level_lengths, repeated_spans
from regweave.llm.suffix import common_prefixes, remove_repeats, repeated_windows, suffix_array, without_repeats


def brute_bytes(rows, length):
    count = collections.Counter()
    texts = {k: (t or "").encode() for k, t in rows}
    for b in texts.values():
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = {}
    for k, b in texts.items():
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                mask[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[k] = (len(b), int(mask.sum()), runs, np.frombuffer(b, np.uint8)[~mask].tobytes())
    return out


def brute_words(rows, length):
    words = {k: (t or "").encode().split() for k, t in rows}
    least = {}
    for k in sorted(words):
        for i in range(len(words[k]) - length + 1):
            least.setdefault(tuple(words[k][i:i + length]), k)
    out = {}
    for k, w in words.items():
        mask = [False] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i:i + length])] < k:
                mask[i:i + length] = [True] * length
        out[k] = (len(w), sum(mask), b" ".join(x for x, m in zip(w, mask) if not m).decode())
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "a"])
def test_suffix_array(alphabet):
    r = random.Random(1)
    text = "".join(r.choice(alphabet) for _ in range(600)).encode()
    assert suffix_array(text, 1000).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_common_prefixes():
    text = b"banana bandana banana bandana"
    a, b = np.array([0, 0, 1, 2]), np.array([7, 15, 3, 9])
    def lcp(i, j):
        n = 0
        while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        return n
    assert common_prefixes(text, a, b, 12).tolist() == [min(12, lcp(i, j)) for i, j in zip(a, b)]


def test_repeated_windows():
    texts = [b"abcdefghij", b"xxabcdefyy", b"zzzzzz"]
    got = repeated_windows(texts, 6)
    assert [np.flatnonzero(g).tolist() for g in got] == [[0], [2], []]


@pytest.mark.parametrize("hot", [2000, 3])
def test_bytes_against_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeats(documents, 200).collect()}
    assert got == brute_bytes(rows, 200)


@pytest.mark.parametrize("length", [13, 30])
def test_words_against_brute_force(documents, length):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeated_spans(documents, length).collect()}
    assert got == brute_words(rows, length)


def test_levels_double():
    for n in (13, 50, 400):
        levels = level_lengths(n)
        assert levels[-1] == n and all(b <= 2 * a for a, b in zip(levels, levels[1:]))


def test_odd_rows(odd_documents, no_documents):
    got = remove_repeats(odd_documents, 128, carry=("size",)).collect()
    assert len(got) == 7 and all(r.n_removed == 0 for r in got) and {r["size"] for r in got} == {1, 2, 3, 4, 5, None}
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in repeated_spans(odd_documents, 13).collect()), key=str)
    # the null id is later than 8, and rows of one id are not earlier than each other
    assert got == sorted([(None, 16, 16), (7, 3, 0), (7, 3, 0), (7, 2, 0), (None, 0, 0), (8, 16, 0), (9, 0, 0)], key=str)
    assert remove_repeats(no_documents).count() == 0 and repeated_spans(no_documents).count() == 0


def test_cut_characters(spark):
    long = "é" * 300
    docs = spark.createDataFrame([(1, "a" + long, "en", "s", 301), (2, "b" + long, "en", "s", 301)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = without_repeats(docs, 400)
    assert got.columns == docs.columns
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("a", 1), ("b", 1)]


def test_columns_named_like_the_result(spark):
    from regweave.llm.mixing import mix_sources
    names = "kept spans n_bytes n_removed id block more passes size target times source_size n __s".split()
    docs = spark.createDataFrame([(i, "word " * 90 + str(i), "en", "s", 1, *range(len(names))) for i in range(3)],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{n} long" for n in names))
    got = without_repeats(docs, 200).collect()
    assert len(got) == 3 and all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in got)
    mixed = mix_sources(docs.drop("__s")).collect()
    assert len(mixed) == 3 and all(r["more"] == 6 and r["passes"] == 7 and r["size"] == 91 for r in mixed)
