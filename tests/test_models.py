import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regweave.functions import solvers
from regweave.operators import design as D
from regweave.operators import models as M
from regweave.operators import motifs
from regweave.plans import inference as P

N_CELLS, N_TF, N_REG = 120, 3, 3


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    tf = rng.poisson(1.5, (N_CELLS, N_TF)).astype(float)
    acc = (rng.random((N_CELLS, N_REG)) < 0.5) * rng.integers(1, 4, (N_CELLS, N_REG)).astype(float)
    lin = 0.5 * tf[:, 0] * acc[:, 0] - 0.3 * tf[:, 1] * acc[:, 1]
    y = np.maximum(np.round(3 + lin + rng.normal(0, 1, N_CELLS)), 0)
    return tf, acc, y


def tables(spark, data):
    tf, acc, y = data
    ex = [(i, f"T{k + 1}", float(tf[i, k])) for i in range(N_CELLS) for k in range(N_TF) if tf[i, k]]
    ex += [(i, "G", float(y[i])) for i in range(N_CELLS) if y[i]]
    ac = [(i, f"c-{k + 1}-9", float(acc[i, k])) for i in range(N_CELLS) for k in range(N_REG)
          if acc[i, k]]
    s = "cell long, feature string, value double"
    pairs = [("G", f"c-{r + 1}-9", f"T{t + 1}") for r, t in [(0, 0), (0, 2), (1, 1), (2, 0)]]
    return (spark.createDataFrame(ex, s), spark.createDataFrame(ac, s),
            spark.range(N_CELLS).withColumnRenamed("id", "cell"),
            spark.createDataFrame(pairs, "target string, region_id string, tf string"))


def dense(data, interaction, scale=False):
    tf, acc, y = data
    if scale:
        tf, acc, y = ((m - m.mean(0)) / m.std(0, ddof=1) for m in (tf, acc, y))
    prs = sorted([(0, 0), (0, 2), (1, 1), (2, 0)])
    cols = []
    if interaction in "+*":
        cols += [acc[:, r] for r in sorted({r for r, _ in prs})]
        cols += [tf[:, t] for t in sorted({t for _, t in prs})]
    if interaction in ":*":
        cols += [acc[:, r] * tf[:, t] for r, t in prs]
    return np.column_stack([np.ones(N_CELLS), *cols]), y


def solved(spark, data, interaction=":", method="glm", scale=False, **kw):
    ex, ac, obs, pairs = tables(spark, data)
    terms = D.model_terms(pairs, interaction)
    if scale:
        base = D.model_terms(pairs, "*")
        g = M.gram_with_size(D.design_rows(base, ex, ac, obs), obs)
        sol = M.solve_grams(M.scaled_gram(g, base, terms, ex, ac, obs), method, **kw)
    else:
        sol = M.fit_models(D.design_rows(terms, ex, ac, obs), obs, method, **kw)
    rows = {r["j"]: r for r in sol.collect()}
    return rows.pop(-1), rows


@pytest.mark.parametrize("interaction", [":", "+", "*"])
@pytest.mark.parametrize("scale", [False, True])
def test_least_squares(spark, data, interaction, scale):
    gof, rows = solved(spark, data, interaction, scale=scale)
    x, y = dense(data, interaction, scale)
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    cov = np.linalg.inv(x.T @ x) * rss[0] / (N_CELLS - x.shape[1])
    assert len(rows) == x.shape[1]
    for j in range(x.shape[1]):
        assert rows[j]["estimate"] == pytest.approx(beta[j], abs=1e-8)
        assert rows[j]["std_err"] == pytest.approx(np.sqrt(cov[j, j]), abs=1e-8)
    assert gof["rsq"] == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_aliased_terms_are_dropped():
    a = np.random.default_rng(1).normal(size=(50, 3))
    x = np.column_stack([a, a[:, 0] + a[:, 1]])
    xc = x - x.mean(0)
    keep = solvers.independent_columns(xc.T @ xc, (x ** 2).sum(0))
    assert keep.tolist() == [0, 1, 2]


def test_weighted_units_equal_replicated_cells(spark, data):
    ex, ac, obs, pairs = tables(spark, data)
    w = obs.withColumn("weight", (F.col("cell") % 3) + 1)
    terms = D.model_terms(pairs)
    a = M.fit_models(D.design_rows(terms, ex, ac, w), w).collect()
    rep = w.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    new = (F.col("cell") * 10 + F.col("k")).alias("cell")

    def copy(d):
        return d.join(rep, "cell").select(new, "feature", "value")
    obs2 = rep.select(new)
    b = M.fit_models(D.design_rows(terms, copy(ex), copy(ac), obs2), obs2).collect()
    ea, eb = ({r["j"]: r["estimate"] for r in x} for x in (a, b))
    pa, pb = ({r["j"]: r["pval"] for r in x} for x in (a, b))
    del ea[-1], eb[-1], pa[-1], pb[-1]
    assert ea == pytest.approx(eb, abs=1e-8) and pa == pytest.approx(pb, abs=1e-8)


def test_poisson_maximises_the_likelihood(spark, data):
    gof, rows = solved(spark, data, family="poisson")
    x, y = dense(data, ":")
    beta = np.array([rows[j]["estimate"] for j in range(x.shape[1])])
    mu = np.exp(x @ beta)
    assert np.abs(x.T @ (y - mu)).max() < 1e-5          # score equations
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ (x * mu[:, None]))))
    assert np.allclose([rows[j]["std_err"] for j in range(x.shape[1])], se, atol=1e-6)

    def dev(m):
        return 2 * np.sum(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0) - (y - m))
    assert gof["rsq"] == pytest.approx(1 - dev(mu) / dev(np.full_like(y, y.mean())), abs=1e-7)


def test_elastic_net_meets_optimality_conditions(spark, data):
    gof, rows = solved(spark, data, method="glmnet", alpha=0.5)
    x, y = dense(data, ":")
    x = x[:, 1:]
    sd, sy = x.std(0), y.std()
    b = np.array([rows[j]["estimate"] for j in range(1, x.shape[1] + 1)]) * sd / sy
    xs, ys = (x - x.mean(0)) / sd, (y - y.mean()) / sy
    lam = gof["lambda"] / sy
    grad = xs.T @ (ys - xs @ b) / N_CELLS - lam * 0.5 * b
    active = b != 0
    assert np.allclose(grad[active], lam * 0.5 * np.sign(b[active]), atol=1e-3)
    assert (np.abs(grad[~active]) <= lam * 0.5 + 1e-3).all()
    assert 0 < gof["rsq"] < 1


def test_penalised_poisson_meets_optimality_conditions(spark, data):
    gof, rows = solved(spark, data, method="glmnet", family="poisson", n_lambda=8)
    x, y = dense(data, ":")
    beta = np.array([rows[j]["estimate"] for j in range(x.shape[1])])
    mu, sd = np.exp(x @ beta), x[:, 1:].std(0)
    grad = x[:, 1:].T @ (y - mu) / N_CELLS / sd
    bs = beta[1:] * sd
    lam = gof["lambda"]
    for g, b in zip(grad, bs):
        if b != 0:
            assert g == pytest.approx(lam * 0.5 * np.sign(b) + lam * 0.5 * b, abs=1e-3)
        else:
            assert abs(g) <= lam * 0.5 + 1e-3


@pytest.mark.parametrize("method,kw", [
    ("cv.glmnet", {"folds": 5}), ("bagging_ridge", {"bagging_number": 30}),
    ("bayesian_ridge", {}), ("brms", {}), ("xgb", {"nrounds": 4, "eta": 0.3})])
def test_every_method_finds_the_signal(spark, data, method, kw):
    gof, rows = solved(spark, data, method=method, **kw)
    assert 0.1 < gof["rsq"] < 1
    if method == "xgb":
        assert sum(r["gain"] for r in rows.values()) == pytest.approx(1)
        assert max(rows.values(), key=lambda r: r["gain"])["j"] == 1
    else:
        assert rows[1]["estimate"] > 0.05 and rows[3]["estimate"] < 0


def test_bags_do_not_depend_on_the_number_of_passes(spark, data, monkeypatch):
    from regweave.operators import gram
    ex, ac, obs, pairs = tables(spark, data)
    rows = D.design_rows(D.model_terms(pairs), ex, ac, obs)

    def sums():
        return {(r["rep"], r["i"], r["j"]): r["s"]
                for r in gram.gram_sums(rows, bags=5, seed=3).collect()}
    whole = sums()
    monkeypatch.setattr(gram, "_BAGS_PER_PASS", 2)
    assert sums() == pytest.approx(whole)
    assert {k[0] for k in whole} == set(range(5))


def test_bayesian_ridge_fixed_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = x @ [1.0, 0.5, 0, 0] + rng.normal(size=200)
    xc, yc = x - x.mean(0), y - y.mean()
    sys = solvers.System(200.0, x.mean(0), y.mean(), xc.T @ xc, xc.T @ yc, yc @ yc,
                         (x ** 2).sum(0), np.arange(1, 5))
    coefs, fit = solvers.bayesian_ridge(sys)
    assert np.allclose(coefs["estimate"], np.linalg.lstsq(xc, yc, rcond=None)[0], atol=0.02)
    assert coefs["pval"].iloc[0] < 1e-6 and coefs["pval"].iloc[3] > 0.01


def study(spark, data):
    ex, ac, obs, pairs = tables(spark, data)
    ann = spark.createDataFrame([("G", "gene", "c", 1, 50, "+"), ("T1", "gene", "d", 1, 50, "+")],
                                "gene string, type string, chrom string, start long, end long, strand string")
    feats = spark.createDataFrame([(f, f == "G") for f in ("G", "T1", "T2", "T3")],
                                  "feature string, is_variable boolean")
    regs = spark.createDataFrame([(f"c-{k}-9", "c", k, 9, f"c-{k}-9") for k in (1, 2, 3)],
                                 "region_id string, chrom string, start long, end long, peak_id string")
    hits = spark.createDataFrame([(f"c-{k}-9", f"M{m}") for k in (1, 2, 3) for m in (1, 2, 3)],
                                 "region_id string, motif string")
    mtf = spark.createDataFrame([(f"M{m}", f"T{m}") for m in (1, 2, 3)] + [("M1", "G"), ("M1", "Z")],
                                "motif string, tf string")
    cells = obs.withColumn("pool", (F.col("cell") % 4).cast("string"))
    return P.Study(ex, ac, cells, feats, ann, regs).set_motifs(hits, mtf)


def test_higher_cutoffs_only_remove_pairs(spark, data):
    s = study(spark, data)
    sets = [{tuple(r) for r in P.find_candidates(s, tf_cor=t, peak_cor=p).pairs.collect()}
            for t, p in [(0.0, 0.0), (0.1, 0.0), (0.2, 0.2), (0.9, 0.0), (0.0, 0.9)]]
    assert sets[0] > set() and sets[1] <= sets[0] and sets[2] <= sets[1]
    assert not sets[3] and not sets[4]
    assert all(r[2] not in ("G", "Z") for r in sets[0])     # no self, no unmeasured TF


def test_networks_and_skipped_targets(spark, data):
    s = study(spark, data)
    net = P.infer_network(s, tf_cor=0.05)
    assert net.coefs.columns[:4] == ["tf", "target", "region", "term"]
    assert {"padj", "corr", "estimate"} <= set(net.coefs.columns)
    n = net.coefs.count()
    assert n > 1 and net.gof.first()["nvariables"] == n
    agg = P.infer_network(s, tf_cor=0.0, aggregate_rna_col="pool", aggregate_peaks_col="pool")
    assert agg.coefs.count() >= 1
    genes = spark.createDataFrame([("G",), ("T1",), ("Q",)], "gene string")
    c = P.find_candidates(s, genes)
    why = {r["target"]: r["reason"] for r in P.skipped_targets(s, c, genes).collect()}
    assert why == {"T1": "no nearby region", "Q": "not annotated"}


def test_motif_scan_and_sequences(spark):
    genome = spark.createDataFrame([("c", 0, "AAAACGTTTT"), ("c", 10, "GGGGACTGGG")],
                                   "chrom string, offset long, seq string")
    regions = spark.createDataFrame([("r1", "c", 4, 12), ("r2", "c", 13, 20)],
                                    "region_id string, chrom string, start long, end long")
    seqs = motifs.region_sequences(regions, genome, 10)
    assert {tuple(r) for r in seqs.collect()} == {("r1", "ACGTTTTGG"), ("r2", "GGACTGGG")}
    pwm = spark.createDataFrame(
        [("M", p, b, 5 if b == "AGT"[p] else -5) for p in range(3) for b in "ACGT"],
        "motif string, pos int, base string, score int")
    best = {r["region_id"]: r["score"] for r in motifs.best_scores(seqs, pwm).collect()}
    assert best == {"r1": 5, "r2": 15}      # AGT is the reverse complement of ACT


def test_failed_fits_are_left_out_and_told(spark, data):
    ex, ac, obs, pairs = tables(spark, data)
    negative = ex.unionByName(spark.createDataFrame([(0, "B", -3.0), (1, "B", 2.0)], ex.schema))
    both = pairs.unionByName(spark.createDataFrame([("B", "c-1-9", "T1")], pairs.schema))
    rows = D.design_rows(D.model_terms(both, ":"), negative, ac, obs)
    got = {r["target"] for r in M.fit_models(rows, obs, "glm", "poisson").collect()}
    assert got == {"G"}
    one = both.select(F.col("target").alias("gene")).distinct()
    named = one.withColumnRenamed("gene", "target")
    told = D.skip_reasons(one, one, named, named, named, named, spark.createDataFrame([("G",)], "target string"))
    assert [tuple(r) for r in told.collect()] == [("B", "fit failed")]


def test_missing_p_values_are_not_counted(spark):
    from regweave.operators.adjust import adjust_pvalues
    d = spark.createDataFrame([(0.01,), (0.02,), (float("nan"),), (None,)], "pval double")
    got = {str(r["pval"]): r["padj"] for r in adjust_pvalues(d).collect()}
    assert got == {"0.01": 0.02, "0.02": 0.02, "nan": None, "None": None}


def test_missing_chunks_are_unknown_bases(spark):
    genome = spark.createDataFrame([("c", 0, "AAAA"), ("c", 8, "CCCC")], "chrom string, offset long, seq string")
    region = spark.createDataFrame([("r", "c", 1, 12)], "region_id string, chrom string, start long, end long")
    assert motifs.region_sequences(region, genome, 4).first()["seq"] == "AAAANNNNCCCC"


def test_exact_signed_rank(spark):
    from itertools import product

    from regweave.operators import metrics
    for n in (1, 4, 9):
        sums = sorted(sum(k + 1 for k in range(n) if s[k]) for s in product((0, 1), repeat=n))
        expected = [sum(x <= v for x in sums) / 2 ** n for v in range(n * (n + 1) // 2 + 1)]
        assert metrics.rank_sum_tails(n) == pytest.approx(expected)
    rows = [("a", x) for x in (1.0, 2.0, 3.0, -4.0, 5.0, 6.0)] + [("ties", x) for x in (1.0, 1.0, -2.0)]
    rows += [("zero", x) for x in (0.0, 1.0, -2.0)] + [("long", float(x + 1)) for x in range(60)]
    got = {r.k: r for r in metrics.wilcoxon_test(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    sums = [sum(k + 1 for k in range(6) if s[k]) for s in product((0, 1), repeat=6)]
    assert got["a"].v == 17 and got["a"].pval == pytest.approx(2 * sum(x >= 17 for x in sums) / 64)
    for k in ("ties", "zero", "long"):
        assert got[k].pval == pytest.approx(math.erfc(abs(got[k].z) / math.sqrt(2)))


@pytest.mark.parametrize("family,link", [("Gamma", None), ("Gamma", "log"), ("inverse.gaussian", None),
                                         ("inverse.gaussian", "log"), ("quasipoisson", None), ("poisson", "identity")])
def test_families_with_estimated_dispersion(spark, data, family, link):
    """Score equations, and standard errors from Fisher's information and Pearson's sum."""
    tf, acc, y = data
    ex, ac, obs, pairs = tables(spark, (tf, acc, y + 2.0))
    rows = D.design_rows(D.model_terms(pairs), ex, ac, obs)
    got = {r["j"]: r for r in M.fit_models(rows, obs, "glm", family, link=link).collect()}
    x, y = dense((tf, acc, y + 2.0), ":")
    beta = np.array([got[j]["estimate"] for j in range(x.shape[1])])
    eta = x @ beta
    link = link or {"Gamma": "inverse", "inverse.gaussian": "1/mu^2", "quasipoisson": "log"}[family]
    mu, slope = {"inverse": lambda: (1 / eta, -eta**-2.0), "log": lambda: (np.exp(eta), np.exp(eta)),
                 "1/mu^2": lambda: (eta**-0.5, -0.5 * eta**-1.5), "identity": lambda: (eta, np.ones_like(eta))}[link]()
    var = mu ** {"Gamma": 2, "inverse.gaussian": 3}.get(family, 1)
    assert np.abs(x.T @ ((y - mu) * slope / var)).max() < 1e-4 * np.abs(x.T @ np.abs(slope / var)).max()
    phi = 1.0 if family == "poisson" else ((y - mu) ** 2 / var).sum() / (N_CELLS - x.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (slope**2 / var)[:, None]))) * phi)
    assert np.allclose([got[j]["std_err"] for j in range(x.shape[1])], se, rtol=1e-4)
    assert 0 < got[-1]["rsq"] < 1
    if family == "Gamma":
        m = y.mean()
        fit = 2 * ((y - mu) / mu - np.log(y / mu)).sum() / (2 * ((y - m) / m - np.log(y / m)).sum())
        assert got[-1]["rsq"] == pytest.approx(1 - fit, abs=1e-6)


def test_positive_families_need_positive_responses(spark, data):
    ex, ac, obs, pairs = tables(spark, data)          # the response has zeros
    rows = D.design_rows(D.model_terms(pairs), ex, ac, obs)
    assert 0 in data[2] and M.fit_models(rows, obs, "glm", "Gamma").count() == 0
    with pytest.raises(ValueError):
        M.fit_models(rows, obs, "glm", "multinomial")
    with pytest.raises(ValueError):
        M.fit_models(rows, obs, "glm", "Gamma", link="probit")


@pytest.mark.parametrize("method,kw", [("cv.glmnet", {"folds": 4}), ("bagging_ridge", {"bagging_number": 20}),
                                       ("xgb", {"nrounds": 5, "eta": 0.3}), ("glmnet", {}), ("bayesian_ridge", {})])
@pytest.mark.parametrize("interaction", [":", "*"])
def test_scaled_fits_equal_fits_of_scaled_columns(spark, data, method, kw, interaction):
    """All methods on z-scores: the same as the method on a dense table of their products."""
    s = study(spark, data)
    net = P.infer_network(s, method=method, interaction=interaction, scale=True, tf_cor=0.0, fit_options=kw)
    c = P.find_candidates(s, tf_cor=0.0)
    terms = D.model_terms(c.pairs, interaction)
    tf, acc, y = ((m - m.mean(0)) / m.std(0, ddof=1) for m in data)
    rows = [("G", i, -1, float(y[i]), 1.0) for i in range(N_CELLS)]
    for r in terms.collect():
        v = np.ones(N_CELLS)
        if r["tf"]:
            v = v * tf[:, int(r["tf"][1:]) - 1]
        if r["region_id"]:
            v = v * acc[:, int(r["region_id"].split("-")[1]) - 1]
        rows += [("G", i, r["j"], float(v[i]), 1.0) for i in range(N_CELLS)]
    d = spark.createDataFrame(rows, "target string, cell long, j int, v double, w double")
    expected = {r["j"]: r for r in M.fit_models(d, c.obs, method, **kw).collect()}
    names = {r["term"]: r["j"] for r in terms.collect()}
    column = M.COEF_COLUMNS[method][0]
    got = {names[r["term"]]: r[column] for r in net.coefs.collect()}
    want = {j: r[column] for j, r in expected.items() if j > 0}
    assert got == pytest.approx(want, abs=1e-6)
    assert net.gof.first()["rsq"] == pytest.approx(expected[-1]["rsq"], abs=1e-6)
