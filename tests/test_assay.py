import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regweave.operators import adjust, assay
from regweave.operators import correlation as C
from regweave.operators import metrics as X

MATRIX = np.array([[1, 1, 1, 1], [2, 3, 4, 5], [6, 7, 8, 9], [2, 4, 6, 8]], float)


def long(spark, m, names="ABCDEFGH"):
    rows = [(i, names[j], float(m[i, j])) for i in range(m.shape[0])
            for j in range(m.shape[1]) if m[i, j] != 0]
    return spark.createDataFrame(rows, "cell long, feature string, value double")


def cells(spark, groups):
    return spark.createDataFrame(list(enumerate(groups)), "cell long, grp_col string")


def sparse_matrix(seed=5, n=40, p=5):
    rng = np.random.default_rng(seed)
    m = rng.integers(-2, 6, (n, p)) * (rng.random((n, p)) < 0.6)
    m[:, 0] = np.where(m[:, 0] < 0, 0, m[:, 0])
    return m.astype(float)


STATS = {
    "mean": np.mean, "sum": np.sum, "median": np.median, "max": np.max, "min": np.min,
    "sd": lambda x: np.std(x, ddof=1), "count": lambda x: np.sum(x != 0),
    "any": lambda x: float(np.any(x != 0)), "all": lambda x: float(np.all(x != 0)),
    "mad": lambda x: 1.4826 * np.median(np.abs(x - np.median(x))),
}


@pytest.mark.parametrize("fun", sorted(STATS))
def test_group_statistics_count_zeros(spark, fun):
    m = np.vstack([sparse_matrix(), MATRIX @ np.eye(4, 5)])
    groups = [("A", "A", "B", "C")[i % 4] for i in range(len(m))]
    got = assay.aggregate_values(long(spark, m), cells(spark, groups), ["grp_col"], fun).collect()
    assert got
    for r in got:
        col = m[[g == r["grp"] for g in groups], "ABCDE".index(r["feature"])]
        assert float(r["value"]) == pytest.approx(float(STATS[fun](col)), abs=1e-9)


def test_single_member_group_has_no_sd(spark):
    d = assay.aggregate_values(long(spark, MATRIX), cells(spark, "AABC"), ["grp_col"], "sd")
    assert {r["grp"] for r in d.collect() if r["value"] is None} == {"B", "C"}


def test_ungrouped_and_custom(spark):
    v, c = long(spark, MATRIX), cells(spark, "AABA")
    d = {r["feature"]: r["value"] for r in assay.aggregate_values(v, c).collect()}
    assert d == pytest.approx(dict(zip("ABCD", MATRIX.mean(axis=0))))
    d = assay.aggregate_values(v, c, ["grp_col"], lambda f: f.max() - f.min())
    got = {r["feature"]: r["value"] for r in d.filter("grp = 'A'").collect()}
    assert got == pytest.approx(dict(zip("ABCD", np.ptp(MATRIX[[0, 1, 3]], axis=0))))


def test_group_columns_are_checked(spark):
    c = spark.createDataFrame([(1, "x"), (2, None)], "cell long, pool string")
    with pytest.raises(ValueError):
        assay.with_group(c, "nope")
    with pytest.raises(ValueError):
        assay.with_group(c, "pool", check=True)
    assert {r["grp"] for r in assay.with_group(c, "pool").collect()} == {"x", "NA"}


def ranks(x):
    return pd.Series(x).rank().to_numpy()


def tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (dx * dy).sum() / np.sqrt((dx ** 2).sum() * (dy ** 2).sum())


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
@pytest.mark.parametrize("m", [MATRIX, sparse_matrix()], ids=["small", "sparse"])
def test_correlation_matches_dense(spark, method, m):
    fn = {"pearson": lambda a, b: np.corrcoef(a, b)[0, 1],
          "spearman": lambda a, b: np.corrcoef(ranks(a), ranks(b))[0, 1], "kendall": tau_b}[method]
    got = C.correlate(long(spark, m), cells(spark, ["g"] * len(m)), method=method).collect()
    assert len(got) == m.shape[1] * (m.shape[1] + 1) // 2
    for r in got:
        a, b = m[:, "ABCDE".index(r["x"])], m[:, "ABCDE".index(r["y"])]
        assert r["cor"] == pytest.approx(fn(a, b), abs=1e-9)


def test_constant_feature_has_zero_correlation(spark):
    m = np.column_stack([np.ones(6), np.arange(6)])
    got = C.correlate(long(spark, m), cells(spark, ["g"] * 6)).filter("x <> y").first()
    assert got["cor"] == 0.0


def p_adjust(p, method):
    p = np.asarray(p)
    n, o = len(p), np.argsort(p, kind="stable")
    i, s = np.arange(1, n + 1), p[np.argsort(p, kind="stable")]
    if method == "bonferroni":
        q = s * n
    elif method == "holm":
        q = np.maximum.accumulate((n - i + 1) * s)
    elif method == "none":
        q = s
    else:
        f = {"fdr": n / i, "BH": n / i, "BY": (1 / i).sum() * n / i, "hochberg": n - i + 1}[method]
        q = np.minimum.accumulate((f * s)[::-1])[::-1]
    out = np.empty(n)
    out[o] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("method", adjust.METHODS)
def test_adjustment_with_ties_and_missing(spark, method):
    rng = np.random.default_rng(0)
    p = np.r_[np.round(rng.random(60) ** 3, 2), np.full(40, 1.0), 0.0, 1e-300]
    rows = [(i, float(x)) for i, x in enumerate(p)] + [(999, None)]
    d = adjust.adjust_pvalues(spark.createDataFrame(rows, "id long, pval double"), method=method)
    got = {r["id"]: r["padj"] for r in d.collect()}
    assert got.pop(999) is None
    assert np.allclose([got[i] for i in range(len(p))], p_adjust(p, method), atol=1e-12)


def test_top_values_keep_ties(spark):
    rows = [("g", x) for x in (5.0, 4.0, 4.0, 3.0)] + [("h", -1.0)]
    d = assay.top_values(spark.createDataFrame(rows, "g string, s double"), "g", "s", 2)
    assert sorted(r["s"] for r in d.collect()) == [-1.0, 4.0, 4.0, 5.0]


def test_folds_are_balanced(spark):
    rows = spark.range(1000).withColumn("s", F.col("id") % 3)
    d = X.cv_folds(rows, "id", 7, "s").toPandas()
    sizes = d.groupby(["s", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all() and set(d["fold"]) == set(range(1, 8))


def test_student_and_normal_tails():
    from regweave.functions.tails import normal_two_sided, student_two_sided
    # Tabulated two-sided 5 % points.
    for df, t in [(1, 12.7062047364), (5, 2.5705818356), (30, 2.0422724563), (1000, 1.9623390808)]:
        assert student_two_sided([t], df)[0] == pytest.approx(0.05, abs=1e-9)
    assert normal_two_sided([1.959963984540054])[0] == pytest.approx(0.05, abs=1e-12)
