"""Shown means of paths against their SQL where many lie halfway between two roundings."""

import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check_oracle  # noqa: E402
import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Edges from 16 sales each, so that estimates are multiples of 0.000625."""
    rng = np.random.default_rng(5)
    rows, order = [], 0
    for part in range(40):
        for supplier in rng.choice(40, 4, replace=False):
            for _ in range(16):
                order += 1
                rows.append((order, part, int(supplier), 1, 1.0, float(rng.integers(2, 13)) / 100, 0.01))
    path = str(tmp_path_factory.mktemp("halves"))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                          "l_quantity double, l_discount double, l_tax double").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["tf_paths", "tf_network_pruned"])
def test_halfway_means_match_sql(spark, halves, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{halves}/lineitem.parquet/*.parquet'")
    msg, ok = check_oracle.compare(spark, con, name, halves, entry.oracle_sql()[name])
    assert ok, msg


def test_networks_write_no_regions_of_paths(spark, monkeypatch):
    from regweave.operators import graph
    edges = spark.createDataFrame([("a", "b", 1.0, "r1", 0.01), ("b", "c", -2.0, "r2", 0.02), ("a", "c", 0.5, "r3", 0.04)],
                                  "from_node string, to_node string, estimate double, regions string, padj double")
    cut, written = graph.cut_lineage, []
    monkeypatch.setattr(graph, "cut_lineage", lambda d, *k: written.append(d.columns) or cut(d, *k))
    roots = spark.createDataFrame([("a",)], "root string")
    for by in ("mean_estimate", "mean_log_padj"):
        got = graph.tf_network(edges, roots, min_paths=1, by=by)
        assert {(r["end_node"], r["from_node"], r["to_node"], r["comb_dir"]) for r in got.collect()} == {
            ("b", "a", "b", 1.0), ("c", "a", "c", 1.0)}
    scored = [c for c in written if "path" in c]
    assert scored and all(len(c) == 6 and "path_regions" not in c for c in scored)
