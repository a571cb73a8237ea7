"""From candidate links to the terms and design rows of per-target models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.operators.gram import RESPONSE
from regweave.operators.skew import salted_join

_KINDS = {":": ("tf_region",), "+": ("region", "tf"), "*": ("region", "tf", "tf_region")}
# Main effects precede products, as in a model formula.
_KIND_ORDER = {"region": 0, "tf": 1, "tf_region": 2}


def target_features(annotation: DataFrame, features: DataFrame,
                    genes: DataFrame | None = None) -> DataFrame:
    """Annotated, requested and measured genes; variable features by default."""
    if genes is None:
        genes = features.filter("is_variable").select(F.col("feature").alias("gene"))
    return (annotation.select("gene").distinct()
            .join(genes.select("gene"), "gene", "left_semi")
            .join(features.select(F.col("feature").alias("gene")), "gene", "left_semi"))


def peak_gene_filter(correlations: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """Keep region-target pairs with ``|r| > cutoff`` (strict)."""
    return correlations.filter(F.abs("cor") > cutoff)


def candidate_tf_targets(links: DataFrame, region_tf: DataFrame) -> DataFrame:
    """``(target, region_id, tf)`` where the region has the TF's motif and TF <> target."""
    return (links.join(region_tf, "region_id")
            .filter(F.col("tf") != F.col("target"))
            .select("target", "region_id", "tf"))


def model_pairs(candidates: DataFrame, tf_links: DataFrame) -> DataFrame:
    """Region-TF pairs of each target after both correlation filters."""
    return (candidates
            .join(tf_links.select("target", "tf"), ["target", "tf"], "left_semi")
            .select("target", "region_id", "tf").distinct())


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``nvariables`` counts region-TF pairs, not design columns."""
    return pairs.groupBy("target").agg(F.count(F.lit(1)).alias("nvariables"))


def model_terms(pairs: DataFrame, interaction: str = ":") -> DataFrame:
    """``(target, j, kind, tf, region_id, term)`` for ``:``, ``+`` or ``*``."""
    if interaction not in _KINDS:
        raise ValueError("interaction must be ':', '+' or '*'")
    null = F.lit(None).cast("string")
    parts = []
    for kind in _KINDS[interaction]:
        tf = F.col("tf") if kind != "region" else null
        region = F.col("region_id") if kind != "tf" else null
        parts.append(pairs.select("target", F.lit(kind).alias("kind"), tf.alias("tf"),
                                  region.alias("region_id")).distinct())
    terms = parts[0]
    for p in parts[1:]:
        terms = terms.unionByName(p)
    rank = F.create_map(*[F.lit(x) for kv in _KIND_ORDER.items() for x in kv])
    # A target's terms are the columns of one model: a small, bounded group.
    w = W.partitionBy("target").orderBy(rank[F.col("kind")], "region_id", "tf")
    label = F.concat_ws(":", F.translate("region_id", "-", "_"), F.translate("tf", "-", "_"))
    return terms.withColumn("j", F.row_number().over(w)).withColumn("term", label)


def design_rows(terms: DataFrame, expression: DataFrame, accessibility: DataFrame,
                obs: DataFrame | None = None) -> DataFrame:
    """Non-zero design values ``(target, cell, j, v, w)`` including the response.

    A product term is non-zero only where both factors are, so terms are first
    attached to the sparser accessibility values and the TF value is then looked
    up by (cell, tf).
    """
    ex = expression.select("cell", F.col("feature").alias("tf"),
                           F.col("value").cast("double").alias("tv"))
    ac = accessibility.select("cell", F.col("feature").alias("region_id"),
                              F.col("value").cast("double").alias("av"))
    t = terms.select("target", "j", "kind", "tf", "region_id")
    prod = t.filter("kind = 'tf_region'").drop("kind")
    out = (salted_join(ac, prod, ["region_id"], ["cell"]).join(ex, ["cell", "tf"])
           .select("target", "cell", "j", (F.col("av") * F.col("tv")).alias("v")))
    main_tf = t.filter("kind = 'tf'").select("target", "j", "tf")
    out = out.unionByName(salted_join(ex, main_tf, ["tf"], ["cell"])
                          .select("target", "cell", "j", F.col("tv").alias("v")))
    main_rg = t.filter("kind = 'region'").select("target", "j", "region_id")
    out = out.unionByName(salted_join(ac, main_rg, ["region_id"], ["cell"])
                          .select("target", "cell", "j", F.col("av").alias("v")))
    targets = terms.select(F.col("target").alias("tf")).distinct()
    y = salted_join(ex, targets, ["tf"], ["cell"], how="left_semi")
    out = out.unionByName(y.select(F.col("tf").alias("target"), "cell",
                                   F.lit(RESPONSE).alias("j"), F.col("tv").alias("v")))
    out = out.filter("v <> 0")
    if obs is None or "weight" not in obs.columns:
        return out.withColumn("w", F.lit(1.0))
    return out.join(obs.select("cell", F.col("weight").cast("double").alias("w")), "cell")


def skip_reasons(targets: DataFrame, annotated: DataFrame, links: DataFrame,
                 kept_links: DataFrame, candidates: DataFrame, pairs: DataFrame,
                 fitted: DataFrame | None = None) -> DataFrame:
    """``(target, reason)`` for targets that get no model, by the first test failed.

    ``fitted(target)`` lists the models that were fitted; without it, a fit that
    failed is not told.
    """
    def flag(df, col, name):
        return df.select(F.col(col).alias("target")).distinct().withColumn(name, F.lit(True))
    d = (targets.select(F.col("gene").alias("target"))
         .join(flag(annotated, "gene", "f1"), "target", "left")
         .join(flag(links, "target", "f2"), "target", "left")
         .join(flag(kept_links, "target", "f3"), "target", "left")
         .join(flag(candidates, "target", "f4"), "target", "left")
         .join(flag(pairs, "target", "f5"), "target", "left"))
    reason = (F.when(F.col("f1").isNull(), "not annotated")
              .when(F.col("f2").isNull(), "no nearby region")
              .when(F.col("f3").isNull(), "no correlated region")
              .when(F.col("f4").isNull(), "no motif in region")
              .when(F.col("f5").isNull(), "no correlated TF"))
    if fitted is not None:
        d = d.join(flag(fitted, "target", "f6"), "target", "left")
        reason = reason.when(F.col("f6").isNull(), "fit failed")
    return d.select("target", reason.alias("reason")).filter("reason is not null")
