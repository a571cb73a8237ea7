"""TF modules: filtering, counting and reducing coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators.assay import top_values
from regweave.operators.skew import salted_join
from regweave.session import cut_lineage

_SELECTED = ("glmnet", "cv.glmnet")


def models_use(gof: DataFrame, rsq_thresh: float = 0.1, nvar_thresh: int = 10) -> DataFrame:
    return (gof.filter((F.col("rsq") > rsq_thresh) & (F.col("nvariables") > nvar_thresh))
            .select("target").distinct())


def filter_coefs(coefs: DataFrame, gof: DataFrame, method: str = "glm", p_thresh: float = 0.05,
                 rsq_thresh: float = 0.1, nvar_thresh: int = 10, xgb_method: str = "tf",
                 xgb_top: int = 50) -> DataFrame:
    """Coefficients of good models that pass the method's own criterion."""
    used = models_use(gof, rsq_thresh, nvar_thresh)
    kept = salted_join(coefs, used, ["target"], ["tf", "region"], how="left_semi")
    if method in _SELECTED:
        return kept.filter("estimate <> 0")
    if method == "xgb":
        if xgb_method not in ("tf", "target"):
            raise ValueError("xgb_method must be 'tf' or 'target'")
        # The cut-off and the rows above it are separate passes.
        top = top_values(cut_lineage(kept), xgb_method, "gain", xgb_top)
        return top.withColumn("estimate", F.signum("corr") * F.col("gain"))
    return kept.filter(F.col("padj").isNull() | (F.col("padj") < p_thresh))


def module_counts(coefs: DataFrame) -> DataFrame:
    """Per (target, tf): rows and the distinct counts around them."""
    sites = coefs.groupBy("target", "tf").agg(F.count(F.lit(1)).alias("tf_sites_per_gene"))
    per_target = coefs.groupBy("target").agg(
        F.count(F.lit(1)).alias("nvars"), F.count_distinct("tf").alias("tf_per_gene"),
        F.count_distinct("region").alias("peak_per_gene"))
    per_tf = coefs.groupBy("tf").agg(F.count_distinct("target").alias("gene_per_tf"))
    d = salted_join(sites, per_target, ["target"], ["tf"])
    return salted_join(d, per_tf, ["tf"], ["target"])


def reduce_modules(coefs: DataFrame, counts: bool = True) -> DataFrame:
    """One row per (tf, target): summed estimate, smallest p-values, region list.

    The counts are taken from these rows, which are written once; without
    ``counts`` the coefficients are grouped once and nothing is written.
    """
    has_p = "padj" in coefs.columns

    def smallest(c):
        # A missing p-value makes the minimum missing.
        return F.when(F.count(c) == F.count(F.lit(1)), F.min(c)).alias(c)
    aggs = [F.sum("estimate").alias("estimate"),
            F.array_sort(F.collect_list("region")).alias("regions")]   # sites of one TF at one gene
    if has_p:
        aggs += [smallest("pval"), smallest("padj")]
    m = coefs.groupBy("target", "tf").agg(*aggs)
    ps = ["pval", "padj"] if has_p else []
    if not counts:
        return (m.filter("target is not null and tf is not null")
                .select("tf", "target", "estimate", "regions", *ps))
    m = cut_lineage(m)
    sites = (m.select("target", F.explode("regions").alias("region")).distinct()
             .groupBy("target").agg(F.count(F.lit(1)).alias("n_regions")))
    per_target = (m.groupBy("target").agg(F.count("tf").alias("n_tfs"))
                  .join(sites, "target", "left").fillna(0, ["n_regions"]))
    per_tf = m.groupBy("tf").agg(F.count("target").alias("n_genes"))
    d = salted_join(salted_join(m, per_target, ["target"], ["tf"]), per_tf, ["tf"], ["target"])
    return d.select("tf", "target", "estimate", "n_regions", "n_genes", "n_tfs", "regions", *ps)


def find_modules(coefs: DataFrame, gof: DataFrame, method: str = "glm", counts: bool = True,
                 **thresholds) -> DataFrame:
    """Module table: one row per TF-target edge that survived the filters."""
    if method in (*_SELECTED, "xgb"):
        coefs = coefs.drop("pval", "padj")
    return reduce_modules(filter_coefs(coefs, gof, method, **thresholds), counts)


def _directed(modules: DataFrame, min_genes: int) -> DataFrame:
    """Module rows with their direction, small modules removed."""
    d = modules.filter("estimate <> 0").withColumn(
        "direction", F.when(F.col("estimate") > 0, "pos").otherwise("neg"))
    big = (d.groupBy("tf", "direction").agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > min_genes).select("tf", "direction"))
    return salted_join(d, big, ["tf", "direction"], ["target"], how="left_semi")


def module_members(modules: DataFrame, min_genes_per_module: int = 5) -> DataFrame:
    """``(tf, direction, kind, member)``, one row per gene or region of a module."""
    d = _directed(modules, min_genes_per_module)
    genes = d.select("tf", "direction", F.lit("genes").alias("kind"),
                     F.col("target").cast("string").alias("member"))
    regions = d.select("tf", "direction", F.lit("regions").alias("kind"),
                       F.explode(F.transform("regions", lambda x: x.cast("string"))).alias("member"))
    return genes.unionByName(regions)


def module_peaks(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Parent peaks of module regions, each once per module."""
    r = members.filter("kind = 'regions'").select("tf", "direction", "member").distinct()
    names = regions.select(F.col("region_id").cast("string").alias("member"),
                           F.col("peak_id").cast("string").alias("peak"))
    return (r.join(names, "member")
            .select("tf", "direction", F.lit("peaks").alias("kind"), F.col("peak").alias("member"))
            .distinct())


def module_sets(members: DataFrame) -> DataFrame:
    """Sorted member lists per module (at most the measured genes or their sites)."""
    return members.groupBy("tf", "direction", "kind").agg(
        F.array_sort(F.collect_list("member")).alias("members"))
