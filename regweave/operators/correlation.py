"""Sparse covariance and correlation for candidate feature pairs.

Only requested pairs are formed: the pair list meets slices of the values
(:mod:`regweave.operators.packed`), so work follows the stored values of candidate
pairs, not features squared, and only sums are sent on.
Moments come from per-feature sums; zeros are never materialised.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regweave.functions.columns import all_salts, safe_divide, salt_of
from regweave.operators.packed import pair_products
from regweave.operators.skew import running_counts, salted_join
from regweave.session import cut_lineage

#: Features of a block and stored values of a slice, about.
FEATURE_BLOCK = 1024
SLICE_VALUES = 200_000


def _weighted(values: DataFrame, obs: DataFrame | None) -> DataFrame:
    """``(cell, feature, value, w)``; the weight is how many cells a row stands for."""
    v = values.select("cell", "feature", F.col("value").cast("double").alias("value"))
    if obs is None or "weight" not in obs.columns:
        return v.withColumn("w", F.lit(1.0))
    return v.join(obs.select("cell", F.col("weight").cast("double").alias("w")), "cell")


def observation_count(obs: DataFrame) -> Column:
    """Number of cells as a scalar subquery (sum of weights when present)."""
    n = F.sum("weight") if "weight" in obs.columns else F.count(F.lit(1))
    return obs.agg(n.cast("double").alias("n")).scalar()


def feature_sums(values: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    v = _weighted(values, obs)
    return v.groupBy("feature").agg(
        F.sum(F.col("w") * F.col("value")).alias("s1"),
        F.sum(F.col("w") * F.col("value") * F.col("value")).alias("s2"))


def cross_products(x: DataFrame, y: DataFrame, pairs: DataFrame,
                   obs: DataFrame | None = None) -> DataFrame:
    """``(x, y, sxy)`` for pairs that are non-zero together in some cell."""
    return pair_products(x, y, pairs, obs)


def covariance_pairs(x: DataFrame, y: DataFrame, pairs: DataFrame, obs: DataFrame,
                     products: DataFrame | None = None) -> DataFrame:
    """``(x, y, cov, cor)``; ``cor`` is NULL where a feature is constant."""
    if products is None:
        products = cross_products(x, y, pairs, obs)
    n = observation_count(obs)
    sx = feature_sums(x, obs).toDF("x", "sx", "sxx")
    sy = feature_sums(y, obs).toDF("y", "sy", "syy")
    zero = F.lit(0.0)
    d = (pairs.select("x", "y").distinct()
         .join(sx, "x", "left").join(sy, "y", "left")
         .join(products, ["x", "y"], "left")
         .fillna(0.0, ["sx", "sxx", "sy", "syy", "sxy"])
         .withColumn("n", n))
    nn = F.col("n")
    cov = safe_divide(F.col("sxy") - F.col("sx") * F.col("sy") / nn, nn - 1)
    vx = safe_divide(F.col("sxx") - F.col("sx") * F.col("sx") / nn, nn - 1)
    vy = safe_divide(F.col("syy") - F.col("sy") * F.col("sy") / nn, nn - 1)
    den = F.sqrt(F.greatest(vx, zero)) * F.sqrt(F.greatest(vy, zero))
    return d.select("x", "y", cov.alias("cov"), safe_divide(cov, den).alias("cor"))


def all_pairs(features: DataFrame, salt: int = 32) -> DataFrame:
    """Every unordered pair (and the diagonal) of a module-level feature set.

    One row per entry of the upper triangle, which is the requested result; the
    work is split over ``salt`` tasks.
    """
    a = features.select(F.col("feature").alias("x"), salt_of("feature", buckets=salt).alias("_s"))
    b = features.select(F.col("feature").alias("y"), all_salts(salt).alias("_s"))
    return a.join(b, "_s").filter("x <= y").drop("_s")


def cross_products_within(x: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """``(x, y, sxy)`` for all co-occurring pairs within one assay, ``x <= y``.

    Features are dealt to blocks and cells to salts, both by the measured size. The
    stored values of a (feature block, salt) are one packed slice; a task multiplies
    the two slices of a (block, block, salt) and sends on one partial sum per pair,
    so pairs are never emitted per cell and no array is wider than a block.
    """
    v = _weighted(x, obs)
    n, features = v.agg(F.count(F.lit(1)), F.approx_count_distinct("feature")).first()
    blocks = max(1, math.ceil(features / FEATURE_BLOCK))
    salts = max(1, math.ceil(n / (blocks * SLICE_VALUES)))
    slices = (v.groupBy(salt_of("cell", buckets=salts).alias("salt"), salt_of("feature", buckets=blocks).alias("block"))
              .agg(F.collect_list(F.struct("cell", "feature", "value", "w")).alias("entries")))
    cells = slices.withColumn("other", all_salts(blocks)).select(
        "salt", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "entries")
    ftype = x.schema["feature"].dataType.simpleString()
    partial = cells.groupBy("salt", "a", "b").applyInArrow(_multiply, f"x {ftype}, y {ftype}, sxy double")
    return (partial.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
            .agg(F.sum("sxy").alias("sxy")))


def _multiply(table: pa.Table) -> pa.Table:
    """Weighted products of two slices, or of one with itself; none where a block pair has one slice only."""
    out = {"x": [], "y": [], "sxy": []}
    alone = table["a"][0].as_py() == table["b"][0].as_py()
    if alone or len(table) == 2:
        lists = table["entries"].combine_chunks()
        slices = [lists[i].values for i in range(len(table))]
        columns = [[s.field(c).to_numpy(zero_copy_only=False) for c in ("cell", "feature", "value", "w")] for s in slices]
        cells, at = np.unique(np.concatenate([c[0] for c in columns]), return_inverse=True)
        rows = np.split(at, np.cumsum([len(c[0]) for c in columns])[:-1])
        named = [np.unique(c[1], return_inverse=True) for c in columns]
        weight = np.ones(len(cells))
        for r, c in zip(rows, columns):
            weight[r] = c[3]
        total = np.zeros((len(named[0][0]), len(named[-1][0])))
        step = max(1, 4_000_000 // max(total.shape))
        for lo in range(0, len(cells), step):
            parts = []
            for r, c, (names, place) in zip(rows, columns, named):
                own = np.flatnonzero((r >= lo) & (r < lo + step))
                part = np.zeros((min(step, len(cells) - lo), len(names)))
                np.add.at(part, (r[own] - lo, place[own]), c[2][own])
                parts.append(part)
            total += parts[0].T @ (parts[-1] * weight[lo:lo + step, None])
        i, j = np.nonzero(np.triu(total) if alone else total)
        out = {"x": named[0][0][i], "y": named[-1][0][j], "sxy": total[i, j]}
    kind = table.schema.field("entries").type.value_type.field("feature").type
    return pa.table({"x": pa.array(out["x"], kind), "y": pa.array(out["y"], kind), "sxy": pa.array(out["sxy"], pa.float64())})


def clean_correlation(c: Column, allow_neg: bool = True) -> Column:
    """Missing becomes 0, infinite becomes 1, negatives optionally become 0."""
    r = F.coalesce(c, F.lit(0.0))
    r = F.when(F.isnan(r), F.lit(0.0)).when(
        F.abs(r) == F.lit(float("inf")), F.lit(1.0)).otherwise(r)
    return r if allow_neg else F.greatest(r, F.lit(0.0))


def rank_shift(values: DataFrame, obs: DataFrame) -> DataFrame:
    """Replace values by average rank minus the rank of zero.

    Shifting does not change a correlation and keeps zeros at zero, so ranks
    stay as sparse as the values.
    """
    n = observation_count(obs)
    if "weight" in obs.columns:
        v = _weighted(values, obs)
        counts = v.groupBy("feature", "value").agg(F.sum("w").alias("c"))
    else:
        counts = (values.groupBy("feature", F.col("value").cast("double").alias("value"))
                  .agg(F.count(F.lit(1)).cast("double").alias("c")))
    zero = (counts.groupBy("feature")
            .agg(F.sum(F.when(F.col("value") != 0, F.col("c")).otherwise(0.0)).alias("nz"),
                 F.sum(F.when(F.col("value") < 0, F.col("c")).otherwise(0.0)).alias("neg"))
            .withColumn("zeros", n - F.col("nz"))
            .withColumn("zero_rank", F.col("neg") + (F.col("zeros") + 1) / 2))
    ranked = (running_counts(counts.filter("value <> 0"), ["feature"]).drop("total")
              .join(zero, "feature")
              .withColumn("rank", F.col("below") + (F.col("c") + 1) / 2
                          + F.when(F.col("value") > 0, F.col("zeros")).otherwise(0.0)))
    shifted = ranked.select("feature", "value", (F.col("rank") - F.col("zero_rank")).alias("rank"))
    vals = values.select("cell", "feature", F.col("value").cast("double").alias("value"))
    return (salted_join(vals.filter("value <> 0"), shifted, ["feature", "value"], ["cell"])
            .select("cell", "feature", F.col("rank").alias("value")))


_CODE_BITS = 62


def kendall_pairs(x: DataFrame, y: DataFrame, pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Kendall's tau-b ``(x, y, cor)`` for candidate pairs.

    Cells are first reduced to counts of distinct value combinations, including
    the combinations with implicit zeros. Ordered pairs of combinations are
    counted without forming them: the x ranks are compared bit by bit. Two
    different ranks share a prefix and differ in exactly one next bit, so within
    each (pair, bit, prefix) every "0" row precedes every "1" row in x, and a
    running count along y says how many agree and how many disagree. That is
    n log n rows of group-and-window work.
    """
    if "weight" in obs.columns:
        raise ValueError("Kendall's correlation takes no observation weights")
    n = observation_count(obs)
    xv = x.select("cell", F.col("feature").alias("x"), F.col("value").cast("double").alias("vx"))
    yv = y.select("cell", F.col("feature").alias("y"), F.col("value").cast("double").alias("vy"))
    pairs = pairs.select("x", "y").distinct()
    joint = cut_lineage(salted_join(xv.filter("vx <> 0"), pairs, ["x"], ["cell"])
             .join(yv.filter("vy <> 0"), ["cell", "y"])
             .groupBy("x", "y", "vx", "vy").agg(F.count(F.lit(1)).alias("c")))
    mx = xv.filter("vx <> 0").groupBy("x", "vx").agg(F.count(F.lit(1)).alias("m"))
    my = yv.filter("vy <> 0").groupBy("y", "vy").agg(F.count(F.lit(1)).alias("m"))
    x_only = (mx.join(pairs, "x")
              .join(joint.groupBy("x", "y", "vx").agg(F.sum("c").alias("j")),
                    ["x", "y", "vx"], "left")
              .select("x", "y", "vx", F.lit(0.0).alias("vy"),
                      (F.col("m") - F.coalesce("j", F.lit(0))).alias("c")))
    y_only = (my.join(pairs, "y")
              .join(joint.groupBy("x", "y", "vy").agg(F.sum("c").alias("j")),
                    ["x", "y", "vy"], "left")
              .select("x", "y", F.lit(0.0).alias("vx"), "vy",
                      (F.col("m") - F.coalesce("j", F.lit(0))).alias("c")))
    some = cut_lineage(joint.unionByName(x_only).unionByName(y_only).filter("c > 0"))
    neither = (pairs.join(some.groupBy("x", "y").agg(F.sum("c").alias("j")), ["x", "y"], "left")
               .select("x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"),
                       (n.cast("bigint") - F.coalesce("j", F.lit(0))).alias("c"))
               .filter("c > 0"))
    # Read by every count below; about one row per distinct value combination.
    table = cut_lineage(some.unionByName(neither))

    def pairs_of(c):
        return c * (c - 1) / 2
    tx = table.groupBy("x", "y", "vx").agg(F.sum("c").alias("c"))
    ty = table.groupBy("x", "y", "vy").agg(F.sum("c").alias("c"))
    code = (running_counts(tx, ["x", "y"], value="vx")
            .select("x", "y", "vx", F.col("below").cast("bigint").alias("code"),
                    F.ceil(F.log2(F.col("total") + 1)).cast("int").alias("bits")))
    rows = (table.join(code, ["x", "y", "vx"])
            .withColumn("bit", F.explode(F.sequence(F.lit(0), F.least("bits", F.lit(_CODE_BITS)))))
            .withColumn("prefix", F.call_function("shiftright", F.col("code"), F.col("bit") + 1))
            .withColumn("one", F.call_function(
                "shiftright", F.col("code"), F.col("bit")).bitwiseAND(F.lit(1))))
    keys = ["x", "y", "bit", "prefix"]
    by_y = rows.groupBy(*keys, "vy").agg(
        F.sum(F.when(F.col("one") == 0, F.col("c")).otherwise(0)).alias("c0"),
        F.sum(F.when(F.col("one") == 1, F.col("c")).otherwise(0)).alias("c1"))
    scored = running_counts(by_y, keys, value="vy", weight="c0")
    diff = scored.groupBy("x", "y").agg(F.sum(
        F.col("c1").cast("double")
        * (F.col("below") - (F.col("total") - F.col("below") - F.col("c0")))).alias("diff"))
    size = table.groupBy("x", "y").agg(F.sum("c").alias("c"))
    n0 = size.select("x", "y", pairs_of(F.col("c").cast("double")).alias("n0"))
    n1 = tx.groupBy("x", "y").agg(F.sum(pairs_of(F.col("c").cast("double"))).alias("n1"))
    n2 = ty.groupBy("x", "y").agg(F.sum(pairs_of(F.col("c").cast("double"))).alias("n2"))
    return (n0.join(n1, ["x", "y"]).join(n2, ["x", "y"]).join(diff, ["x", "y"], "left")
            .select("x", "y", safe_divide(
                F.coalesce("diff", F.lit(0.0)),
                F.sqrt(F.col("n0") - F.col("n1")) * F.sqrt(F.col("n0") - F.col("n2"))
            ).alias("cor")))


def correlate(x: DataFrame, obs: DataFrame, y: DataFrame | None = None,
              pairs: DataFrame | None = None, method: str = "pearson",
              allow_neg: bool = True, remove_na: bool = True) -> DataFrame:
    """``(x, y, cor)`` for the given pairs, or all pairs within ``x``."""
    whole = y is None and pairs is None
    if pairs is None:
        if y is not None:
            raise ValueError("name the candidate pairs when correlating two assays")
        pairs = all_pairs(x.select("feature").distinct())
    if method in ("pearson", "spearman"):
        if method == "spearman":
            # Ranks feed both the moments and the products.
            xv = cut_lineage(rank_shift(x, obs))
            yv = xv if y is None else cut_lineage(rank_shift(y, obs))
        else:
            xv, yv = x, x if y is None else y
        products = cross_products_within(xv, obs) if whole else None
        r = covariance_pairs(xv, yv, pairs, obs, products).select("x", "y", "cor")
    elif method == "kendall":
        r = kendall_pairs(x, x if y is None else y, pairs, obs)
    else:
        raise ValueError("method must be pearson, spearman or kendall")
    if remove_na:
        r = r.withColumn("cor", clean_correlation(F.col("cor"), allow_neg))
    elif not allow_neg:
        r = r.withColumn("cor", F.when(F.col("cor") < 0, 0.0).otherwise(F.col("cor")))
    return r


def mirror(pairs: DataFrame) -> DataFrame:
    """Full matrix in long form from the upper triangle."""
    flipped = pairs.filter("x <> y").select(
        F.col("y").alias("x"), F.col("x").alias("y"),
        *[c for c in pairs.columns if c not in ("x", "y")])
    return pairs.unionByName(flipped)
