"""Turning raw solutions or external coefficient tables into network rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators.adjust import adjust_pvalues

# How a region looks inside a term, and intercept names.
REGION_IN_TERM = r"^\w+_\d+_\d+$"
INTERCEPTS = ("(Intercept)", "Intercept")


def format_coefs(coefs: DataFrame, interaction: str = ":", adjust: str = "fdr",
                 count_intercepts: bool = True) -> DataFrame:
    """``tf, target, region, term, ...`` from a table with textual terms.

    P-values are adjusted over all rows, intercepts included unless told
    otherwise. Either order of TF and region is accepted; a term with one name
    fills only the side it belongs to. ``_`` becomes ``-`` in names.
    """
    is_intercept = F.col("term").isin(*INTERCEPTS)
    if not count_intercepts:
        coefs = coefs.filter(~is_intercept)
    if "pval" in coefs.columns:
        coefs = adjust_pvalues(coefs, method=adjust)
    sep = F.lit(":" if interaction in (":", "*") else interaction)
    parts = F.split("term", F.concat(F.lit("\\s*\\Q"), sep, F.lit("\\E\\s*")))
    a, b = F.get(parts, 0), F.get(parts, 1)
    a_region, b_region = a.rlike(REGION_IN_TERM), F.coalesce(b.rlike(REGION_IN_TERM), F.lit(False))
    region = F.when(a_region, a).when(b_region, b)
    tf = F.when(~a_region, a).otherwise(F.when(~b_region, b))

    def dashed(c):
        return F.translate(c, "_", "-")
    rest = [c for c in coefs.columns if c not in ("tf", "target", "region", "term")]
    return (coefs.filter(~is_intercept)
            .select(dashed(tf).alias("tf"), dashed(F.col("target")).alias("target"),
                    dashed(region).alias("region"), "term", *rest))


def attach_terms(solution: DataFrame, terms: DataFrame, columns: list[str],
                 adjust: str = "fdr", count_intercepts: bool = True) -> DataFrame:
    """Name solved coefficients by their structured terms (no text parsing)."""
    rows = solution.filter("j >= 0" if count_intercepts else "j > 0")
    if "pval" in columns:
        rows = adjust_pvalues(rows, method=adjust)
        columns = [*columns, "padj"]
    named = terms.select("target", "j", "tf", F.col("region_id").alias("region"), "term")
    return (rows.filter("j > 0").join(named, ["target", "j"])
            .select("tf", "target", "region", "term", *columns))


def attach_correlation(coefs: DataFrame, tf_links: DataFrame) -> DataFrame:
    """Left join of TF-target correlations on (target, tf)."""
    c = tf_links.select("target", "tf", F.col("cor").alias("corr"))
    return coefs.join(c, ["target", "tf"], "left").select(*coefs.columns, "corr")
