"""Multiple-testing adjustment without a single-partition sort.

An adjusted value depends only on the p-value and on how many p-values are
smaller, so rows are reduced to distinct p-values first. Running counts and
running extremes are taken inside order-preserving buckets and combined over
the (few) bucket totals. Very frequent p-values are joined back by broadcast of
a list of at most 1,000 entries, the rest by an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.functions.columns import unit_bucket
from regweave.operators.skew import running_counts

METHODS = ("fdr", "BH", "BY", "bonferroni", "holm", "hochberg", "none")
_HOT_SHARE = 1000      # a p-value is frequent from 1/1000 of all rows on


def _running_extreme(df: DataFrame, q: str, kind: str) -> DataFrame:
    """Running max from the smallest p up, or running min from the largest p down."""
    b = df.withColumn("_b", unit_bucket(F.col("value")))
    agg = F.max if kind == "max" else F.min
    pick = F.greatest if kind == "max" else F.least
    if kind == "max":
        inner = W.partitionBy("_b").orderBy("value")
        outer = W.partitionBy(F.lit(0)).orderBy("_b")
    else:
        inner = W.partitionBy("_b").orderBy(F.col("value").desc())
        outer = W.partitionBy(F.lit(0)).orderBy(F.col("_b").desc())
    local = agg(q).over(inner.rowsBetween(W.unboundedPreceding, W.currentRow))
    sums = b.groupBy("_b").agg(agg(q).alias("_x"))
    carry = sums.select("_b", agg("_x").over(
        outer.rowsBetween(W.unboundedPreceding, -1)).alias("_c"))
    return (b.withColumn("_l", local).join(carry, "_b")
            .withColumn("adj", pick("_l", F.coalesce("_c", "_l"))).drop("_b", "_l", "_c"))


def adjusted_values(df: DataFrame, p: str = "pval", method: str = "fdr") -> DataFrame:
    """``(value, c, total, adj)`` per distinct non-null p-value."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    counts = (df.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))
              .groupBy(F.col(p).cast("double").alias("value"))
              .agg(F.count(F.lit(1)).alias("c")))
    r = running_counts(counts, [], bucket=unit_bucket(F.col("value")))
    one, n = F.lit(1.0), F.col("total")
    if method == "none":
        return r.withColumn("adj", F.col("value"))
    if method == "bonferroni":
        return r.withColumn("adj", F.least(one, F.col("value") * n))
    top_rank = F.col("below") + F.col("c")
    if method == "holm":
        r = r.withColumn("q", (n - F.col("below")) * F.col("value"))
        r = _running_extreme(r, "q", "max")
    elif method == "hochberg":
        r = _running_extreme(r.withColumn("q", (n - top_rank + 1) * F.col("value")), "q", "min")
    else:
        r = r.withColumn("q", F.col("value") * n / top_rank)
        if method == "BY":
            r = r.withColumn("q", F.col("q") * harmonic(n))
        r = _running_extreme(r, "q", "min")
    return r.withColumn("adj", F.least(one, F.col("adj"))).drop("q")


def harmonic(n):
    """1 + 1/2 + ... + 1/n: summed below 64, asymptotic series above (error < 1e-15)."""
    x = n.cast("double")
    exact = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(64)).cast("int")), F.lit(0.0),
                        lambda a, k: a + F.lit(1.0) / k)
    gamma = 0.5772156649015329     # Euler-Mascheroni constant
    tail = (F.log(x) + F.lit(gamma) + F.lit(0.5) / x - F.lit(1 / 12) / (x * x)
            + F.lit(1 / 120) / (x * x * x * x) - F.lit(1 / 252) / F.pow(x, F.lit(6.0)))
    return F.when(n <= 64, exact).otherwise(tail)


def adjust_pvalues(df: DataFrame, p: str = "pval", out: str = "padj",
                   method: str = "fdr") -> DataFrame:
    """Add adjusted p-values; NULL and NaN p-values get NULL and are not counted."""
    adj = adjusted_values(df, p, method).select(
        F.col("value").alias("_p"), F.col("adj").alias(out),
        (F.col("c") * _HOT_SHARE > F.col("total")).alias("_hot"))
    key = F.col(p).cast("double")
    rows = df.withColumn("_p", F.when(~F.isnan(key), key))
    # At most 1,000 values can each hold more than 1/1000 of the rows.
    hot = F.broadcast(adj.filter("_hot").select("_p", out))
    tagged = rows.join(hot, "_p", "left")
    done = tagged.filter(F.col(out).isNotNull() | F.col("_p").isNull())
    rest = tagged.filter(F.col(out).isNull() & F.col("_p").isNotNull()).drop(out)
    cold = rest.join(adj.filter("not _hot").select("_p", out), "_p")
    cols = [*df.columns, out]
    return done.select(*cols).unionByName(cold.select(*cols))
