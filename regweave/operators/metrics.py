"""Error metrics, significance tests over draws, folds and report tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.functions import tails
from regweave.functions.columns import pseudo_log10, safe_divide
from regweave.operators.skew import running_counts


#: Draws from which the signed-rank test uses the normal distribution.
EXACT_BELOW = 50

def normal_p(z):
    """Two-sided normal p-value of a column."""
    @F.pandas_udf("double")
    def fn(x: pd.Series) -> pd.Series:
        return pd.Series(tails.normal_two_sided(x.to_numpy()))
    return F.when(z.isNotNull(), fn(F.coalesce(z, F.lit(0.0))))


def student_p(t, df):
    """Two-sided Student p-value; degrees of freedom may differ per row."""
    @F.pandas_udf("double")
    def fn(x: pd.Series, d: pd.Series) -> pd.Series:
        out = pd.Series(float("nan"), index=x.index)
        for k, rows in x.groupby(d):
            out[rows.index] = tails.student_two_sided(rows.to_numpy(), float(k))
        return out
    ok = t.isNotNull() & df.isNotNull()
    return F.when(ok, fn(F.coalesce(t, F.lit(0.0)), F.coalesce(df.cast("double"), F.lit(1.0))))


def t_test(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """One-sample t-test against zero per key."""
    d = df.filter(F.col(x).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    t = safe_divide(F.col("mean") * F.sqrt("n"), F.col("sd"))
    return (d.withColumn("statistic", t)
            .withColumn("pval", student_p(F.col("statistic"), F.col("n") - 1)))


def wilcoxon_statistic(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Signed-rank sum ``v`` and its normal score ``z`` per key.

    Zeros are dropped, ties share their average rank, and the variance carries
    the tie correction; ``z`` uses a continuity correction of one half.
    """
    return _signed_ranks(df, keys, x).drop("ties")


def _signed_ranks(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    v = F.col(x)
    counts = (df.filter(v.isNotNull() & (v != 0))
              .groupBy(*keys, F.abs(v).alias("value"))
              .agg(F.count(F.lit(1)).alias("c"), F.count_if(v > 0).alias("pos")))
    r = running_counts(counts, keys)
    rank = F.col("below") + (F.col("c") + 1) / 2
    d = r.groupBy(*keys).agg(
        F.sum(rank * F.col("pos")).alias("v"), F.max("total").cast("double").alias("n"),
        F.sum((F.col("c") * F.col("c") * F.col("c") - F.col("c")).cast("double")).alias("ties"))
    n = F.col("n")
    d = d.withColumn("diff", F.col("v") - n * (n + 1) / 4)
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = safe_divide(F.col("diff") - F.signum("diff") * 0.5, sigma)
    return d.select(*keys, "v", "n", z.alias("z"), "ties")


def rank_sum_tails(n: int) -> np.ndarray:
    """``P(V <= v)`` of the signed-rank sum of ``n`` draws, ``v`` from 0 to n (n + 1) / 2.

    The distribution by dynamic programming: rank k is either in the sum or not.
    """
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for k in range(1, n + 1):
        counts[k:] += counts[:-k].copy()
    return np.cumsum(counts) / 2.0 ** n


def signed_rank_p(v: Column, n: Column) -> Column:
    """Exact two-sided p-value of a signed-rank sum without ties, for fewer than ``EXACT_BELOW`` draws."""
    @F.pandas_udf("double")
    def fn(v: pd.Series, n: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=v.index)
        for k, rows in v.groupby(n):
            below, x, k = rank_sum_tails(int(k)), np.rint(rows.to_numpy()).astype(int), int(k)
            low, high = below[x], 1.0 - np.where(x > 0, below[x - 1], 0.0)
            out[rows.index] = np.minimum(1.0, 2.0 * np.where(4 * x > k * (k + 1), high, low))
        return out
    return fn(v.cast("double"), n.cast("int"))


def wilcoxon_test(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Signed-rank test against zero per key: ``v, n, z, pval``.

    Below ``EXACT_BELOW`` draws without zeros and ties ``pval`` is exact, else it is
    that of ``z``.
    """
    v = F.col(x)
    zeros = df.filter(v == 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("_zeros"))
    d = _signed_ranks(df, keys, x).join(zeros, keys, "left")
    exact = F.col("_zeros").isNull() & (F.col("ties") == 0) & (F.col("n") < EXACT_BELOW)
    safe = [F.when(exact, F.col(c)).otherwise(F.lit(1.0)) for c in ("v", "n")]
    return d.select(*keys, "v", "n", "z", F.when(exact, signed_rank_p(*safe)).otherwise(
        normal_p(F.col("z"))).alias("pval"))


def error_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred",
                  keys: list[str] | None = None) -> DataFrame:
    """mae, mape, mse, rmse, sse, rse and r2 in one aggregation."""
    y, p = F.col(truth), F.col(pred)
    e = p - y
    d = df.groupBy(*(keys or [])).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(safe_divide(e, y))).alias("mape"),
        F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("sse"),
        F.sum(y).alias("_s1"), F.sum(y * y).alias("_s2"), F.count(y).alias("_n"))
    total = F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n")
    return (d.withColumn("rmse", F.sqrt("mse"))
            .withColumn("rse", safe_divide(F.col("sse"), total))
            .withColumn("r2", 1 - F.col("rse")).drop("_s1", "_s2", "_n"))


def absolute_errors(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.withColumn("ae", F.abs(F.col(pred) - F.col(truth)))


def cv_folds(df: DataFrame, id_col: str, folds: int = 5, strata: str | None = None,
             seed: int = 1) -> DataFrame:
    """Assign each row a fold; sizes differ by at most one within a stratum.

    The position within a stratum is a running count over hash buckets, so a
    stratum with a third of all rows is still numbered by many tasks.
    """
    s = F.col(strata) if strata else F.lit(0)
    h = F.xxhash64(id_col, F.lit(seed))
    d = df.withColumn("_s", s).withColumn("_h", h).withColumn("_b", F.shiftright("_h", 52))
    sizes = d.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    off = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(
        W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("_o"))
    w = W.partitionBy("_s", "_b").orderBy("_h", id_col)
    return (d.withColumn("_r", F.row_number().over(w)).join(off, ["_s", "_b"])
            .withColumn("fold", ((F.col("_r") + F.col("_o") - 1) % folds + 1).cast("int"))
            .select(*df.columns, "fold"))


def gof_quality(gof: DataFrame, rsq_thresh: float = 0.1, nvar_thresh: int = 10) -> DataFrame:
    """Plausible fits with a flag for those a module search would use."""
    return gof.filter(F.col("rsq").between(0, 1)).withColumn(
        "nice", (F.col("rsq") > rsq_thresh) & (F.col("nvariables") > nvar_thresh))


def histogram(df: DataFrame, column: str, bins: int = 20, pseudo_log: bool = False) -> DataFrame:
    """``(bin, lo, hi, n)`` over equal-width bins of the (transformed) range."""
    x = pseudo_log10(F.col(column).cast("double")) if pseudo_log else F.col(column).cast("double")
    d = df.select(x.alias("x"))
    lohi = d.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("r")).scalar()
    d = d.withColumn("r", lohi)
    width = (F.col("r.hi") - F.col("r.lo")) / F.lit(bins)
    # Rounding keeps values on a bin edge on the same side everywhere.
    pos = F.floor(F.round(safe_divide(F.col("x") - F.col("r.lo"), width), 9))
    b = F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (d.withColumns({"bin": b, "w": width})
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("r.lo").alias("_lo"),
                                F.first("w").alias("_w"))
            .select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "n"))


def gof_histograms(gof: DataFrame, bins: int = 20) -> DataFrame:
    """Marginal histograms of explained variance and (pseudo-log) model size."""
    ok = gof.filter(F.col("rsq").between(0, 1))
    a = histogram(ok, "rsq", bins).withColumn("variable", F.lit("rsq"))
    b = histogram(ok, "nvariables", bins, True).withColumn("variable", F.lit("nvariables"))
    return a.unionByName(b)


def module_metric_values(modules: DataFrame) -> DataFrame:
    """Distinct (metric, key, value) rows behind the module size report."""
    parts = [("regions_per_target", "target", "n_regions"), ("tfs_per_target", "target", "n_tfs"),
             ("genes_per_tf", "tf", "n_genes")]
    out = None
    for name, key, val in parts:
        d = modules.select(F.lit(name).alias("metric"), F.col(key).cast("string").alias("key"),
                           F.col(val).cast("long").alias("value")).distinct()
        out = d if out is None else out.unionByName(d)
    return out


def module_metric_summary(modules: DataFrame) -> DataFrame:
    v = F.col("value").cast("double")
    return module_metric_values(modules).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"),
        F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.percentile(v, F.lit(0.75)).alias("q3"), F.max("value").alias("max"),
        F.avg("value").alias("mean"))
