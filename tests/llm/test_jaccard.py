"""Jaccard join against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regweave.llm import jaccard
from regweave.llm.components import connected_components
from regweave.llm.jaccard import one_of_each, similar_documents


def brute(rows, size=5, per_cent=75):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    keys = sorted(sets)
    first = {}
    for k in keys:
        if sets[k]:
            first.setdefault(sets[k], k)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= per_cent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
                if x != y and first[x] == a and first[y] == b:
                    links[a] += 1
                    links[b] += 1
    return {k: (len(sets[k]), root(k), links[first[sets[k]]] if sets[k] else 0) for k in keys}


@pytest.mark.parametrize("per_cent", [75, 40])
def test_against_brute_force(documents, per_cent):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = similar_documents(documents, per_cent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(rows, per_cent=per_cent)
    assert {r.doc_id for r in got if r["first"]} == {r.component_id for r in got}


def test_odd_rows(odd_documents, no_documents):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r["first"]) for r in similar_documents(odd_documents).collect()), key=str)
    assert got == sorted([(None, 12, 8, False), (8, 12, 8, True), (7, 1, 7, True), (7, 1, 7, False), (7, 1, 7, True),
                          (None, 0, None, True), (9, 0, 9, True)], key=str)
    kept = one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(8, "a b c d e f g h i j k l m n o p"), (7, "one two three"), (7, "another text"), (None, None), (9, "")], key=str)
    assert similar_documents(no_documents).count() == 0 and one_of_each(no_documents).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (203, 201), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200, 203: 200}


def near_copies(n, words=100):
    """Different texts, each with one word of its own."""
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    texts = []
    for i in range(n):
        base[i % words], old = f"own{i}", base[i % words]
        texts.append(" ".join(base))
        base[i % words] = old
    return texts


def test_links_of_a_group_are_counted_not_listed():
    sets = jaccard.shingle_sets([t.encode() for t in near_copies(300)], 5)
    part = [(i, np.sort(s | np.uint64(1 << 56))) for i, s in enumerate(sets)]
    rows = [(b, np.frombuffer(d, np.int64).reshape(-1, 2)) for batch in jaccard._verifier(75, 4)(0, part, {})
            for b, d in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist())]
    assert sum(len(x) for _, x in rows) < 2 * len(sets)  # 89,700 when both ways of all pairs are kept
    counts = np.concatenate([x for b, x in rows if b % 2 == 0])
    assert sorted(counts.tolist()) == [[i, 299] for i in range(300)]


def test_sets_of_one_least_token_have_several_homes(spark):
    sets = spark.range(1000).select(F.lit(7).cast("long").alias("least"), F.col("id").alias("node"))
    sizes = [r["count"] for r in jaccard._homes(sets, 8).groupBy("home").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) > 4 and max(sizes) < 400


def test_a_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SET_BYTES", 8_000)
    texts = near_copies(120) + near_copies(20, 60)
    rows = list(enumerate(texts + texts[:3]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = similar_documents(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(rows)
