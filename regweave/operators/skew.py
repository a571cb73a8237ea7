"""Joins and running totals that hold up when one key owns much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.functions.columns import all_salts, order_bucket, salt_of

DEFAULT_SALT = 8


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: list[str],
                how: str = "inner", salt: int = DEFAULT_SALT) -> DataFrame:
    """Join with the rows of one key of ``big`` spread over ``salt`` tasks.

    ``small`` is repeated once per salt value; use it for feature- or node-level
    tables against observation- or edge-level ones. ``how`` may be any type that
    keeps rows of ``big`` only (inner, left, left_semi, left_anti).
    """
    if salt <= 1:
        return big.join(small, on, how)
    b = big.withColumn("_salt", salt_of(*spread_by, buckets=salt))
    s = small.withColumn("_salt", all_salts(salt))
    return b.join(s, [*on, "_salt"], how).drop("_salt")


def running_counts(counts: DataFrame, keys: list[str], value: str = "value",
                   weight: str = "c", bucket: Column | None = None) -> DataFrame:
    """Add ``below`` (weight of smaller values) and ``total`` (weight of all) per key.

    Input has one row per key and value. The running sum is taken within
    order-preserving buckets and the bucket totals are summed separately, so a
    key with very many distinct values is spread over many tasks and the second
    window only sees one row per bucket.
    """
    b = order_bucket(F.col(value)) if bucket is None else bucket
    keyed = counts.withColumn("_b", b)
    before = W.unboundedPreceding, -1
    inner = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(*before)
    local = keyed.withColumn("_in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    sums = keyed.groupBy(*keys, "_b").agg(F.sum(weight).alias("_w"))
    part = [F.col(k) for k in keys] or [F.lit(0)]
    offs = sums.select(
        *keys, "_b",
        F.coalesce(F.sum("_w").over(W.partitionBy(*part).orderBy("_b").rowsBetween(*before)),
                   F.lit(0)).alias("_off"),
        F.sum("_w").over(W.partitionBy(*part)).alias("total"),
    )
    return (local.join(offs, [*keys, "_b"])
            .withColumn("below", F.col("_in") + F.col("_off"))
            .drop("_b", "_in", "_off"))
