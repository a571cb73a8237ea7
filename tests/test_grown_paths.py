"""Paths that take scores along as they grow, against paths that are scored afterwards."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regweave.operators import graph

COLUMNS = "from_node string, to_node string, estimate double, regions string, padj double"


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(4)
    rows = [(f"n{a}", f"n{b}", float(rng.integers(-3, 4)) / 4, f"r{a}-{b}", [0.0, 0.01, 0.005, None][rng.integers(4)])
            for a in range(16) for b in range(16) if rng.random() < 0.16]
    return spark.createDataFrame(rows, COLUMNS)


def _roots(edges):
    return edges.select(F.col("from_node").alias("root")).distinct()


def _rows(d):
    return sorted(str(tuple(r)) for r in graph.path_text(d).select(sorted(d.columns)).collect())


def _afterwards(monkeypatch):
    monkeypatch.setattr(graph, "_one_per_pair", lambda edges: False)


@pytest.mark.parametrize("order, by", [(1, None), (3, "mean_estimate"), (None, "mean_log_padj")])
def test_scores_on_the_way_equal_scores_afterwards(edges, order, by, monkeypatch):
    got = _rows(graph.scored_paths(edges, _roots(edges), order, by))
    _afterwards(monkeypatch)
    assert got and got == _rows(graph.scored_paths(edges, _roots(edges), order, by))


@pytest.mark.parametrize("options, narrow", [({"min_paths": 1}, True), ({"min_paths": 12}, False), ({"keep_all": True}, True),
                                             ({"by": "mean_log_padj"}, True)])
def test_networks_on_the_way_equal_networks_afterwards(edges, options, narrow, monkeypatch):
    e = edges.select("from_node", "to_node", "estimate", *(["padj"] if "by" in options else [])) if narrow else edges

    def rows(edges):
        d = graph.tf_network(edges, _roots(edges), **options)
        return sorted(str(tuple(r)) for r in d.select("root", "end_node", "comb_dir", *e.columns).collect())
    got = rows(e)
    _afterwards(monkeypatch)
    assert got and got == rows(edges)


def test_parallel_edges_are_scored_afterwards(spark, edges):
    twice = edges.unionByName(edges.withColumn("estimate", F.col("estimate") + 1))
    got = graph.scored_paths(twice, _roots(twice)).filter("order = 1").select("start_node", "end_node", "mean_estimate")
    want = edges.filter("from_node <> to_node").select("from_node", "to_node", F.col("estimate") + 0.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _after_the_levels(d):
    """Exchanges of the plan above the tables of the levels."""
    return d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["scored", "pruned", "network"])
def test_paths_travel_once(spark, edges, name):
    """The last level meets the pairs reached before; nothing is joined or grouped by path afterwards."""
    limit, adaptive = (spark.conf.get(f"spark.sql.{k}") for k in ("autoBroadcastJoinThreshold", "adaptive.enabled"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        e = edges.select("from_node", "to_node", "estimate") if name == "network" else edges
        d = {"scored": lambda: graph.scored_paths(e, _roots(e)), "pruned": lambda: graph.scored_paths(e, _roots(e), by="mean_estimate"),
             "network": lambda: graph.tf_network(e, _roots(e), min_paths=1)}[name]()
        # two sides of the growing step, new paths and reached pairs; edges of tied paths of the level before
        assert _after_the_levels(d) <= (4 if name != "network" else 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_shortest_paths_of_any_length(spark, tmp_path):
    """Suppliers 1 to 7 sell the next one's part, so the longest way has seven links."""
    rows = [(i, k + 1, k, 1, 1.0, 0.06, 0.0) for k in range(7) for i in range(26 * k, 26 * k + 26)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    d = entry.queries()["shortest_paths"](spark, str(tmp_path))
    got = sorted(map(tuple, d.select("root", "end_node", "order", "path").collect()))
    assert got == sorted(con.execute(entry.oracle_sql()["shortest_paths"]).fetchall())
    assert len(got) == 28 and max(r[2] for r in got) == 7
