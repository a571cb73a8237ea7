"""Source divergence against plain loops."""

import collections
import re

import pytest

from regweave.llm import divergence
from regweave.llm.divergence import source_divergence, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        within, whole = collections.Counter(), collections.Counter()
        own = collections.defaultdict(collections.Counter)
        for _, source, words in (d for d in docs if d[0] == lang):
            within.update(set(words))
            whole.update(words)
            own[source].update(words)
        kept = [t for t, n in within.items() if n >= min_docs]

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1000000000 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def got(docs, min_docs, top):
    return sorted(tuple(r) for r in source_divergence(docs, min_docs, top).collect())


def test_terms():
    assert terms_of("Ab1cD é_X y".encode()) == [w.encode() for w in TERM.findall("Ab1cD é_X y".translate(LOWER))]


@pytest.mark.parametrize("groups, terms, held", [(64, 2048, 300_000), (2, 7, 50)])
def test_against_loops(spark, documents, monkeypatch, groups, terms, held):
    for name, n in (("GROUP_BLOCK", groups), ("TERM_BLOCK", terms), ("HELD", held)):
        monkeypatch.setattr(divergence, name, n)
    docs = documents.selectExpr("text", "lang", "if(doc_id % 7 = 0, 'Ä' || doc_id % 5, source) as source", "doc_id as c", "n_chars as p")
    assert got(docs, 3, 5) == brute([(r.text, r.lang, r.source) for r in docs.collect()], 3, 5)


def test_no_kept_terms(spark, documents):
    rows = got(documents, 10_000, 50)
    assert rows and all(r[2] == "pair" and r[4] == 0 for r in rows)
    assert rows == brute([(r.text, r.lang, r.source) for r in documents.collect()], 10_000, 50)


def test_odd_rows(spark, odd_documents, no_documents):
    assert got(no_documents, 1, 50) == []
    assert got(odd_documents, 1, 50) == brute([(r.text, r.lang, r.source) for r in odd_documents.collect()], 1, 50)


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F
    n, c, v = 9 * 10 ** 15, 10 ** 15 + 7, 1234567
    row = spark.range(1).select(divergence._share(F.lit(c), F.lit(n), F.lit(v)).alias("p")).first()
    assert row.p == 1 + 1000000000 * (c + 5) // (n + 5 * v)
