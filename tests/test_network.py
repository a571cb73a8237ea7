import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regweave.operators import coefficients, embedding, graph, modules
from regweave.plans import networks as N
from regweave.plans.inference import Network
from regweave.sources import readers
from regweave.sources.store import NetworkStore, module_summary, network_summary


def edge_list(n=14, k=30, seed=2):
    rng = np.random.default_rng(seed)
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    pick = rng.choice(len(pairs), k, replace=False)
    return [(f"n{pairs[i][0]}", f"n{pairs[i][1]}", float(rng.normal()), "r") for i in pick]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(
        edge_list(), "from_node string, to_node string, estimate double, regions string")


def test_pagerank_matches_dense_iteration(spark, edges):
    e = edge_list()
    names = sorted({x for r in e for x in r[:2]})
    ix = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names),) * 2)
    for a, b, *_ in e:
        m[ix[b], ix[a]] = 1
    out = m.sum(0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / len(names))
    r = np.full(len(names), 1 / len(names))
    for _ in range(200):
        r = 0.15 / len(names) + 0.85 * m @ r
    got = {x["name"]: x["centrality"] for x in graph.pagerank(edges, tol=1e-8).collect()}
    assert got == pytest.approx(dict(zip(names, r)), abs=1e-7)
    assert sum(got.values()) == pytest.approx(1)


def brute_paths(e, root, limit):
    nxt = {}
    for a, b, *_ in e:
        nxt.setdefault(a, []).append(b)
    level, seen, out = [(root,)], {root}, set()
    for _ in range(limit):
        level = [p + (b,) for p in level for b in nxt.get(p[-1], []) if b not in seen]
        out.update(level)
        seen |= {p[-1] for p in level}
    return out


@pytest.mark.parametrize("order", [1, 3, None])
def test_all_shortest_paths(spark, edges, order):
    e = edge_list()
    roots = edges.select(F.col("from_node").alias("root")).distinct()
    got = {tuple(r["path"]) for r in graph.shortest_paths(edges, roots, order=order).collect()}
    want = set(itertools.chain.from_iterable(
        brute_paths(e, r[0], order or 20) for r in roots.collect()))
    assert got == want
    some = spark.createDataFrame([("n1",), ("n3",)], "feature string")
    got = {tuple(r["path"]) for r in graph.shortest_paths(edges, roots, some, order).collect()}
    assert got == {p for p in want if p[-1] in ("n1", "n3")}


def test_levels_repeat_the_smaller_side(spark, monkeypatch):
    e = edge_list(k=60)
    d = spark.createDataFrame(e, "from_node string, to_node string, estimate double, regions string")
    roots, repeated = d.select(F.col("from_node").alias("root")).distinct(), []

    def join(big, small, *args, **kw):
        repeated.append((big.count(), small.count()))
        return salted_join(big, small, *args, **kw)
    salted_join = graph.salted_join
    monkeypatch.setattr(graph, "salted_join", join)
    got = {tuple(r["path"]) for r in graph.shortest_paths(d, roots).collect()}
    assert got == set(itertools.chain.from_iterable(brute_paths(e, r[0], 3) for r in roots.collect()))
    assert all(small <= big for big, small in repeated), repeated


def test_modules_count_their_written_rows(spark):
    rows = [("a", "x", "r1", 1.0), ("a", "x", "r2", 2.0), ("a", "y", "r1", 1.0), ("b", "x", "r1", -1.0),
            (None, "x", "r9", 3.0), ("b", "z", None, 1.0)]
    d = spark.createDataFrame(rows, "tf string, target string, region string, estimate double")
    cols = ["tf", "target", "estimate", "regions", "n_regions", "n_genes", "n_tfs"]
    got = {tuple(map(str, r)) for r in modules.reduce_modules(d).select(*cols).collect()}
    assert got == {("a", "x", "3.0", "['r1', 'r2']", "3", "2", "2"), ("a", "y", "1.0", "['r1']", "1", "2", "1"),
                   ("b", "x", "-1.0", "['r1']", "3", "2", "2"), ("b", "z", "1.0", "[]", "0", "2", "1")}
    few = modules.reduce_modules(d, counts=False)
    assert {tuple(map(str, r)) for r in few.select(*cols[:4]).collect()} == {r[:4] for r in got}


@pytest.mark.parametrize("name", ["find_modules_glmnet", "find_modules_xgb"])
def test_modules_without_counts_read_sales_at_most_twice(spark, name):
    d = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") <= 2


def test_subnetwork_keeps_direct_and_best_paths(spark):
    rows = [("a", "b", 1.0, "r1"), ("a", "c", -2.0, "r2"), ("b", "d", 3.0, "r3"),
            ("c", "d", -1.0, "r4"), ("d", "a", 1.0, "r5")]
    e = spark.createDataFrame(
        rows, "from_node string, to_node string, estimate double, regions string")
    root = spark.createDataFrame([("a",)], "root string")
    scored = graph.path_text(graph.score_paths(graph.shortest_paths(e, root), e))
    got = {r["path"]: (r["dir"], r["mean_estimate"], r["path_regions"]) for r in scored.collect()}
    assert got == {"a;b": (1, 1.0, "r1"), "a;c": (-1, -2.0, "r2"),
                   "a;b;d": (1, 2.0, "r1;r3"), "a;c;d": (1, -1.5, "r2;r4")}
    net = graph.tf_network(e, root)
    assert {(r["from_node"], r["to_node"], r["end_node"]) for r in net.collect()} == {
        ("a", "b", "b"), ("a", "c", "c"), ("a", "b", "d"), ("b", "d", "d")}
    assert graph.tf_network(e, root, keep_all=True).count() == 6
    with pytest.raises(ValueError):
        graph.tf_network(e, spark.createDataFrame([("c",)], "root string"), order=1)


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 6)) * [5, 3, 2, 1, 1, 1]
    rows = [(f"g{i}", f"c{j}", float(m[i, j])) for i in range(30) for j in range(6)]
    d = embedding.principal_components(
        spark.createDataFrame(rows, "gene string, col string, value double"), 2)
    got = d.toPandas().set_index("gene").loc[[f"g{i}" for i in range(30)]].to_numpy()
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_principal_components_of_a_flat_spectrum(spark, monkeypatch):
    monkeypatch.setattr(embedding, "_ALL", 0)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 25))
    rows = [(f"g{i}", f"c{j}", float(m[i, j])) for i in range(40) for j in range(25)]
    d = embedding.principal_components(
        spark.createDataFrame(rows, "gene string, col string, value double"), 3)
    got = d.toPandas().set_index("gene").loc[[f"g{i}" for i in range(40)]].to_numpy()
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    cosine = np.abs((got / np.linalg.norm(got, axis=0) * u[:, :3]).sum(axis=0))
    assert cosine.min() > 0.999
    with pytest.raises(ValueError):
        embedding.principal_components(
            spark.createDataFrame(rows, "gene string, col string, value double"), 3, max_iterations=1)


@pytest.mark.parametrize("rows", [[], [("a", "b", 1.0)]])
def test_graphs_without_any_direction_have_scores_of_zero(spark, rows):
    ex = spark.createDataFrame([(c, f, float(c * k % 5)) for c in range(9) for k, f in enumerate("ab", 1)],
                               "cell long, feature string, value double")
    mods = spark.createDataFrame(rows, "tf string, target string, estimate double")
    nodes, _ = N.network_graph(mods, ex, spark.range(12).withColumnRenamed("id", "cell"))
    assert [(r["name"], r["pc_1"], r["pc_2"]) for r in nodes.collect()] == [(y, 0.0, 0.0) for _, y, _ in rows]


@pytest.fixture(scope="module")
def net(spark):
    coefs = spark.createDataFrame(
        [("T", f"g{i}", "c-1-9", 1.0, 0.01, 0.01, 0.3) for i in range(4)]
        + [("T", "g0", "c-20-29", -3.0, 0.02, None, 0.3), ("U", "g0", "c-1-9", 0.5, 0.9, 0.9, 0.1)],
        "tf string, target string, region string, estimate double, pval double, padj double, corr double")
    gof = spark.createDataFrame([(f"g{i}", 0.5, 20) for i in range(3)] + [("g3", 0.01, 20)],
                                "target string, rsq double, nvariables long")
    targets = gof.select(F.col("target").alias("gene"))
    return Network(coefs, gof, targets, {"method": "glm", "family": "gaussian"})


def test_modules(spark, net):
    regions = spark.createDataFrame([("c-1-9", "peak1"), ("c-20-29", "peak1")],
                                    "region_id string, peak_id string")
    res = N.extract_modules(net, regions, min_genes_per_module=1)
    rows = {(r["tf"], r["target"]): r for r in res.modules.collect()}
    assert set(rows) == {("T", "g0"), ("T", "g1"), ("T", "g2")}      # g3 fits badly, U is not significant
    g0 = rows["T", "g0"]
    assert g0["estimate"] == -2.0 and g0["regions"] == ["c-1-9", "c-20-29"]
    assert (g0["n_regions"], g0["n_genes"], g0["n_tfs"]) == (2, 3, 1)
    assert g0["padj"] is None                                        # missing stays missing
    sets = {(r["direction"], r["kind"]): r["members"]
            for r in modules.module_sets(res.members).collect()}
    assert sets == {("pos", "genes"): ["g1", "g2"], ("pos", "regions"): ["c-1-9", "c-1-9"],
                    ("pos", "peaks"): ["peak1"]}
    nodes, edges = N.network_graph(res.modules, layout="none")
    assert {r["name"] for r in nodes.collect()} == {"T", "g0", "g1", "g2"}
    assert {r["dir"] for r in edges.collect()} == {1.0, -1.0}


def test_store_keeps_networks_apart(spark, net, tmp_path):
    s = NetworkStore(spark, str(tmp_path))
    with pytest.raises(KeyError):
        s.default_network()
    s.save_network("one", net.coefs, net.gof, net.targets, net.params)
    s.save_network("two", net.coefs.limit(1), net.gof, net.targets, {"method": "glmnet"})
    assert s.networks() == ["one", "two"] and s.default_network() == "two"
    assert s.coefs("one").count() == 6 and s.coefs().count() == 1
    s.save_network("two", net.coefs.limit(2), net.gof, net.targets, {"method": "glmnet"}, False)
    assert s.coefs("two").count() == 2 and s.coefs("one").count() == 6
    assert s.params("one")["family"] == "gaussian" and s.targets("one").count() == 4
    with pytest.raises(KeyError):
        s.gof("three")
    res = N.extract_modules(net, min_genes_per_module=1)
    s.save_modules("one", res.modules, res.members, res.params)
    assert module_summary(s.modules("one")[0]).first()["n_modules"] == 1
    s.save_graph("one", *N.network_graph(res.modules, layout="none"))
    assert s.graph("one")[1].count() == 3
    with pytest.raises(KeyError):
        s.graph("one", "other_graph")
    calls = []

    def compute():
        calls.append(1)
        return net.gof
    for _ in range(2):
        assert s.assay_summary("RNA", "pool", compute).count() == 4
    assert len(calls) == 1
    assert network_summary(s.coefs("one")).first()["n_tfs"] == 2


def test_readers(spark, tmp_path):
    rows = [("RNA", "data", 1, "G", 2.0), ("RNA", "counts", 1, "G", 5.0),
            ("peaks", "data", 1, "c-1-2", 1.0), ("RNA", "data", 2, "G", 0.0)]
    d = spark.createDataFrame(rows, "assay string, layer string, cell long, feature string, value double")
    path = str(tmp_path / "assay")
    readers.write_assay(d, path)
    assert [tuple(r) for r in readers.read_layer(spark, path).collect()] == [(1, "G", 2.0)]
    assert readers.read_layer(spark, path, "RNA", "data", slot="counts").first()["value"] == 5.0
    assert readers.read_layer(spark, path, "peaks").count() == 1
    bed = tmp_path / "x.bed"
    bed.write_text("track name=x\nchr1\t0\t10\tn\t0\t-\nchr2\t5\t6\n")
    got = [tuple(r) for r in readers.read_regions(spark, str(bed)).collect()]
    assert got == [("chr1", 1, 10, "n", "-"), ("chr2", 6, 6, None, "*")]
    tsv = tmp_path / "map.tsv"
    tsv.write_text("m\tt\torigin\nM1\tT1\tx\n")
    assert tuple(readers.read_motif_map(spark, str(tsv)).first()) == ("M1", "T1")
    with pytest.raises(ValueError):
        readers.motif_map(spark.createDataFrame([("a",)], "m string"))
    with pytest.raises(ValueError):
        readers.motif_map(spark.createDataFrame([("a", None)], "m string, t string"))
    with pytest.raises(ValueError):
        readers.require_annotation(None)
    feats = spark.createDataFrame([("G", False)], "feature string, is_variable boolean")
    with pytest.raises(ValueError):
        readers.variable_features(feats)


def test_term_parsing_accepts_either_order(spark):
    rows = [("G_1", "(Intercept)", 0.5), ("G_1", "chr1_10_20:T_A", 0.01),
            ("G_1", "T_A:chr1_30_40", 0.02)]
    d = coefficients.format_coefs(spark.createDataFrame(
        rows, "target string, term string, pval double")).orderBy("region")
    got = [(r["tf"], r["target"], r["region"], round(r["padj"], 6)) for r in d.collect()]
    assert got == [("T-A", "G-1", "chr1-10-20", 0.03), ("T-A", "G-1", "chr1-30-40", 0.03)]
    plus = spark.createDataFrame([("G", "chr1_10_20", 0.1), ("G", "T1", 0.1)],
                                 "target string, term string, pval double")
    got = {(r["tf"], r["region"]) for r in coefficients.format_coefs(plus, "+").collect()}
    assert got == {(None, "chr1-10-20"), ("T1", None)}


def test_path_score_with_a_missing_value(spark):
    e = spark.createDataFrame([("a", "b", 1.0, "r", 0.01), ("b", "c", 1.0, "s", None)],
                              "from_node string, to_node string, estimate double, regions string, padj double")
    paths = graph.shortest_paths(e, spark.createDataFrame([("a",)], "root string"))
    got = {r["end_node"]: r["mean_log_padj"] for r in graph.score_paths(paths, e).collect()}
    assert got == {"b": 2.0, "c": None}


def test_attempted_targets_are_the_features_of_a_graph(spark, net):
    regions = spark.createDataFrame([("c-1-9", "peak1"), ("c-20-29", "peak1")], "region_id string, peak_id string")
    mods = N.extract_modules(net, regions, min_genes_per_module=1).modules
    nodes, _ = N.network_graph(mods, layout="none", targets=net.targets)
    assert nodes.count() == 0      # the TF is no attempted target
    both = net.targets.unionByName(spark.createDataFrame([("T",)], "gene string"))
    assert N.network_graph(mods, layout="none", targets=both)[0].count() == 4


def test_results_of_modules_bring_their_targets(spark, net):
    res = N.extract_modules(net, min_genes_per_module=1)
    assert N.network_graph(res, layout="none")[0].count() == 0      # the TF is no attempted target
    assert N.network_graph(res.modules, layout="none")[0].count() == 4
    named = spark.createDataFrame([("T",), ("g0",)], "feature string")
    assert N.network_graph(res, features=named, layout="none")[0].count() == 2


def test_ends_of_a_tf_graph_are_attempted_targets(spark, net):
    e = spark.createDataFrame([("T", f"g{i}", 1.0, "r") for i in range(4)] + [("T", "q", 1.0, "r")],
                              "from_node string, to_node string, estimate double, regions string")
    tfs = spark.createDataFrame([("T",)], "tf string")
    assert {r["end_node"] for r in N.tf_graph(net, e, tfs).collect()} == {"g0", "g1", "g2", "g3"}
    one = spark.createDataFrame([("q",)], "feature string")
    assert {r["end_node"] for r in N.tf_graph(net, e, tfs, one, min_paths=1).collect()} == {"q"}
