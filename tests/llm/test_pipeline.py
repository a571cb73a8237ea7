"""The pipeline against brute-force versions of its stages, and its registration."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_jaccard import brute as brute_links  # noqa: E402
from test_repeats import brute_bytes  # noqa: E402
from test_text_operators import brute_hits  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {f"op{i}_" for i in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    first = stages["near_duplicates"](spark, kept, SF)
    links = brute_links([(r.doc_id, r.text) for r in kept.collect()])
    assert first.columns == columns
    assert sorted(r.doc_id for r in first.collect()) == sorted({v[1] for v in links.values()})
    cut = stages["repeated_strings"](spark, first, SF)
    expected = brute_bytes([(r.doc_id, r.text) for r in first.collect()], corpus_pipeline.REPEAT_BYTES)
    assert cut.columns == columns
    assert {r.doc_id: r.text for r in cut.collect()} == {k: v[3].decode("utf-8", "ignore") for k, v in expected.items()}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    clean = stages["decontamination"](spark, cut, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in cut.collect()], items)
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {k for k, v in hits.items() if not v[1]}
    mix = stages["mixing"](spark, clean, SF)
    assert {r.doc_id for r in mix.collect()} <= {r.doc_id for r in clean.collect()} and mix.filter("times < 1").count() == 0
    final = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.times, r.text) for r in final.collect()) == sorted((r.doc_id, r.times, r.text) for r in mix.collect())


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd_documents, no_documents, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    assert f(spark, no_documents, SF).count() == 0
    got = f(spark, odd_documents, SF)
    assert got.count() <= 7 and set(odd_documents.columns) <= set(got.columns)
