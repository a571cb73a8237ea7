"""Summaries of sparse assays.

``values(cell, feature, value)`` stores no zeros; ``cells(cell, <group columns>)``
lists every observation. Zeros count: each statistic is over all cells of a
group. A row is returned for every (group, feature) with a stored value; absent
rows are all-zero.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.functions.columns import safe_divide
from regweave.operators.skew import running_counts, salted_join

STATISTICS = ("mean", "sum", "count", "median", "max", "min", "any", "all", "sd", "mad")


def with_group(cells: DataFrame, *columns: str, check: bool = False) -> DataFrame:
    """``(cell, grp)``; several columns are pasted with ``_`` and NULL becomes ``NA``."""
    missing = [c for c in columns if c not in cells.columns]
    if missing:
        raise ValueError(f"metadata column {missing[0]!r} was not found")
    if check:
        bad = cells.filter(F.col(columns[0]).isNull()).limit(1)
        if not bad.isEmpty():
            raise ValueError(f"metadata column {columns[0]!r} contains missing values")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]
    return cells.select("cell", F.concat_ws("_", *parts).alias("grp"))


def _one_group(cells: DataFrame) -> DataFrame:
    return cells.select("cell", F.lit("all").alias("grp"))


def _basic(values: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums, extremes and counts per (grp, feature), with the group size ``n``."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value").cast("double")
    stats = values.join(groups, "cell").groupBy("grp", "feature").agg(
        F.sum(v).alias("s1"), F.sum(v * v).alias("s2"),
        F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.count_if(v != 0).alias("nnz"), F.count(F.lit(1)).alias("stored"),
    )
    return stats.join(sizes, "grp")


def _value_counts(values: DataFrame, groups: DataFrame) -> DataFrame:
    """``(grp, feature, value, c)`` including the implicit zeros."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value").cast("double")
    stored = (values.join(groups, "cell").groupBy("grp", "feature", v.alias("value"))
              .agg(F.count(F.lit(1)).alias("c")))
    zeros = (stored.groupBy("grp", "feature")
             .agg(F.sum("c").alias("stored")).join(sizes, "grp")
             .filter("n > stored")
             .select("grp", "feature", F.lit(0.0).alias("value"),
                     (F.col("n") - F.col("stored")).alias("c")))
    return (stored.unionByName(zeros).groupBy("grp", "feature", "value")
            .agg(F.sum("c").alias("c")))


def _median_of_counts(counts: DataFrame) -> DataFrame:
    """Median from value counts: mean of the two middle order statistics."""
    r = running_counts(counts, ["grp", "feature"])
    k1 = F.floor((F.col("total") + 1) / 2)
    k2 = F.ceil((F.col("total") + 1) / 2)

    def covers(k):
        return (F.col("below") < k) & (k <= F.col("below") + F.col("c"))
    return (r.filter(covers(k1) | covers(k2)).groupBy("grp", "feature")
            .agg(F.avg("value").alias("value")))


def aggregate_values(values: DataFrame, cells: DataFrame, groups: list[str] | None = None,
                     fun: str | Callable = "mean") -> DataFrame:
    """``(grp, feature, value)`` for a named statistic or a user function.

    Without ``groups`` the whole assay is one group called ``all``; there
    ``count`` counts entries equal to one, as the whole-matrix summary does.
    A callable receives the dense cells x features frame of one group and
    returns one number per feature.
    """
    g = with_group(cells, *groups) if groups else _one_group(cells)
    if callable(fun):
        return aggregate_custom(values, g, fun)
    if fun not in STATISTICS:
        raise ValueError(f"unknown statistic {fun!r}")
    if fun == "median":
        return _median_of_counts(_value_counts(values, g))
    if fun == "mad":
        counts = _value_counts(values, g)
        med = _median_of_counts(counts).withColumnRenamed("value", "med")
        dev = (counts.join(med, ["grp", "feature"])
               .groupBy("grp", "feature", F.abs(F.col("value") - F.col("med")).alias("value"))
               .agg(F.sum("c").alias("c")))
        return _median_of_counts(dev).withColumn("value", F.col("value") * F.lit(1.4826))
    if fun == "count" and not groups:
        return (values.groupBy(F.lit("all").alias("grp"), "feature")
                .agg(F.count_if(F.col("value") == 1).alias("value")))
    b = _basic(values, g)
    gap = F.col("stored") < F.col("n")
    mean = F.col("s1") / F.col("n")
    var = safe_divide(F.col("s2") - F.col("n") * mean * mean, F.col("n") - 1)
    expr = {
        "mean": mean,
        "sum": F.col("s1"),
        "count": F.col("nnz"),
        "max": F.when(gap, F.greatest(F.col("hi"), F.lit(0.0))).otherwise(F.col("hi")),
        "min": F.when(gap, F.least(F.col("lo"), F.lit(0.0))).otherwise(F.col("lo")),
        "any": F.col("nnz") > 0,
        "all": F.col("nnz") == F.col("n"),
        "sd": F.sqrt(F.greatest(var, F.lit(0.0))),
    }[fun]
    if fun == "sd":
        expr = F.when(F.col("n") > 1, expr)
    return b.select("grp", "feature", expr.alias("value"))


def aggregate_custom(values: DataFrame, groups: DataFrame, fun: Callable) -> DataFrame:
    """User function per group, applied feature block by feature block.

    The work is split by (group, feature), so a task holds one feature's values
    of one group, not a whole group's matrix. ``fun`` takes a frame with one
    column per feature and returns one value per column.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    rows = values.join(groups, "cell").join(sizes, "grp")
    rows = rows.select("grp", "feature", F.col("value").cast("double").alias("value"), "n")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        dense = pd.Series(0.0, index=range(n))
        dense.iloc[: len(pdf)] = pdf["value"].to_numpy()
        result = fun(dense.to_frame(key[1]))
        value = float(pd.Series(result).iloc[0])
        return pd.DataFrame({"grp": [key[0]], "feature": [key[1]], "value": [value]})

    ftype = values.schema["feature"].dataType.simpleString()
    return rows.groupBy("grp", "feature").applyInPandas(
        one, f"grp string, feature {ftype}, value double")


def group_sizes(cells: DataFrame, groups: list[str]) -> DataFrame:
    return with_group(cells, *groups).groupBy("grp").agg(F.count(F.lit(1)).alias("weight"))


def broadcast_to_cells(summary: DataFrame, groups: DataFrame) -> DataFrame:
    """Give every cell its group's value: ``(cell, feature, value)``."""
    return (groups.join(summary, "grp")
            .select("cell", "feature", "value"))


def crosstab_values(values: DataFrame, cells: DataFrame, group: str,
                    levels: list) -> DataFrame:
    """Features x groups table of sums, one column per level (absent = 0)."""
    g = with_group(cells, group)
    wide = (values.join(g, "cell").groupBy("feature").pivot("grp", levels)
            .agg(F.sum("value")))
    return wide.fillna(0, [str(v) for v in levels])


def zscore(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Stored values as z-scores over all cells; zeros map to ``-mean/sd``, which
    is returned per feature by :func:`zscore_origin`."""
    m = zscore_origin(values, cells)
    return salted_join(values, m, ["feature"], ["cell"]).select(
        "cell", "feature",
        safe_divide(F.col("value") - F.col("mean"), F.col("sd")).alias("z"))


def zscore_origin(values: DataFrame, cells: DataFrame) -> DataFrame:
    """``(feature, mean, sd, z0)``: moments and the z-score of a zero."""
    b = _basic(values, _one_group(cells))
    mean = F.col("s1") / F.col("n")
    sd = F.sqrt(F.greatest(
        safe_divide(F.col("s2") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)))
    return (b.select("feature", mean.alias("mean"), sd.alias("sd"))
            .withColumn("z0", safe_divide(-F.col("mean"), F.col("sd"))))


def top_values(df: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """Rows with the ``n`` largest scores per group, ties kept.

    The cut-off is found on distinct scores with running counts over score
    buckets, not by sorting a whole group in one task.
    """
    counts = (df.filter(F.col(score).isNotNull())
              .groupBy(group, (-F.col(score)).alias("value"))
              .agg(F.count(F.lit(1)).alias("c")))
    kept = (running_counts(counts, [group]).filter(F.col("below") < n)
            .groupBy(group).agg((-F.max("value")).alias("_cut")))
    return (salted_join(df, kept, [group], [score]).filter(F.col(score) >= F.col("_cut"))
            .select(*df.columns))


def max_in_group(df: DataFrame, group: list[str], score: str) -> DataFrame:
    w = W.partitionBy(*group)
    return df.withColumn("_m", F.max(score).over(w)).filter(F.col(score) == F.col("_m")).drop("_m")
