"""Grams straight from the assays against those of design rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regweave.operators import correlation as C
from regweave.operators import design as D
from regweave.operators import gram as G
from regweave.operators import models as M
from regweave.operators import packed


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(3)

    def assay(names, share):
        rows = [(c, n, float(rng.integers(1, 9))) for c in range(150) for n in names if rng.random() < share]
        return spark.createDataFrame(rows, "cell long, feature string, value double")
    tfs, regions = [f"t{k}" for k in range(4)], [f"r{k}" for k in range(5)]
    pairs = [(y, r, t) for y in tfs for r in regions for t in tfs if t != y and rng.random() < 0.5]
    pairs = spark.createDataFrame([*pairs, ("gone", "r0", "t0")], "target string, region_id string, tf string")
    obs = spark.range(160).select(F.col("id").alias("cell"), (F.col("id") % 3 + 1).alias("weight"))
    return assay(tfs, 0.6), assay(regions, 0.4), pairs, obs


def _table(d, *keys):
    return {tuple(r[k] for k in keys): r["s"] for r in d.collect()}


@pytest.mark.parametrize("interaction", [":", "*"])
@pytest.mark.parametrize("weighted", [False, True])
def test_grams_equal_those_of_design_rows(spark, parts, interaction, weighted, monkeypatch):
    monkeypatch.setattr(packed, "SLICE_VALUES", 100)
    monkeypatch.setattr(packed, "CHUNK_TERMS", 20)
    ex, ac, pairs, obs = parts
    whole = (D.model_terms(pairs, interaction), ex, ac, obs if weighted else obs.drop("weight"))
    rows, lazy = D.design_rows(*whole), packed.Design(*whole)
    keys = ("target", "i", "j")
    assert _table(G.gram_sums(lazy), *keys) == pytest.approx(_table(G.gram_sums(rows), *keys))
    if interaction == ":":
        for bags in (3, 60):
            got, want = (_table(G.gram_sums(d, bags=bags, seed=7), "rep", *keys) for d in (lazy, rows))
            assert got == pytest.approx(want)
        got, want = (_table(G.gram_by_fold(d, 4, 2), "fold", *keys) for d in (lazy, rows))
        assert got == pytest.approx(want)


@pytest.mark.parametrize("weighted", [False, True])
def test_pair_products_send_sums_only(spark, parts, weighted, monkeypatch):
    monkeypatch.setattr(packed, "SLICE_VALUES", 100)
    monkeypatch.setattr(packed, "CHUNK_TERMS", 5)
    ex, ac, _, obs = parts
    obs = obs if weighted else obs.drop("weight")
    w = {r["cell"]: r["weight"] if weighted else 1 for r in obs.collect()}
    for a, b in ((ex, ac), (ex, ex)):
        pairs = a.select(F.col("feature").alias("x")).distinct().crossJoin(b.select(F.col("feature").alias("y")).distinct())
        want: dict = {}
        for r in a.alias("a").join(b.alias("b"), "cell").select(
                "cell", F.col("a.feature").alias("x"), F.col("b.feature").alias("y"),
                (F.col("a.value") * F.col("b.value")).alias("v")).collect():
            want[r["x"], r["y"]] = want.get((r["x"], r["y"]), 0) + w[r["cell"]] * r["v"]
        got = C.cross_products(a, b, pairs, obs)
        assert {(r["x"], r["y"]): r["sxy"] for r in got.collect()} == pytest.approx(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan      # no join of values with values


@pytest.mark.parametrize("method,family,weighted,options", [
    ("glm", "poisson", True, {"max_iter": 4, "tol": 0.1}), ("glm", "Gamma", False, {"max_iter": 2}),
    ("glmnet", "poisson", True, {"n_lambda": 4})])
def test_reweighted_fits_from_slices_equal_those_of_design_rows(spark, parts, method, family, weighted, options, monkeypatch):
    monkeypatch.setattr(packed, "SLICE_VALUES", 100)
    monkeypatch.setattr(packed, "CHUNK_TERMS", 20)
    ex, ac, pairs, obs = parts
    whole = (D.model_terms(pairs, ":"), ex, ac, obs if weighted else obs.drop("weight"))
    fits = []
    for design in (D.design_rows(*whole), packed.Design(*whole)):
        fits.append({(r["target"], r["j"]): (r["estimate"], r["pval"], r["rsq"], r["lambda"])
                     for r in M.fit_models(design, whole[-1], method, family, **options).collect()})
    assert fits[0].keys() == fits[1].keys() and bool(fits[0]) == (family == "poisson")
    for k, want in fits[0].items():
        assert fits[1][k] == pytest.approx(want, abs=1e-6, nan_ok=True)


def test_the_query_of_penalised_counts_has_the_whole_path(spark, monkeypatch):
    """All 100 penalties, of which only those that still move are computed again."""
    from regweave.operators import irls
    asked, sums = [], irls._SlicedPasses.sums

    def counted(self, beta, reps):
        asked.append([len(r.beta) for r in beta.collect()])
        return sums(self, beta, reps)
    monkeypatch.setattr(irls._SlicedPasses, "sums", counted)
    d = entry.queries()["glmnet_poisson"](spark, "/root/testdata/sf0.001")
    assert asked and set(asked[0]) == {100} and min(min(a) for a in asked) < 100
    assert d.count() > 0
