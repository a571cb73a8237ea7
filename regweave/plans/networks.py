"""From a fitted network to modules and graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators import embedding, graph, modules
from regweave.operators.correlation import (
    clean_correlation, correlate, covariance_pairs, mirror)
from regweave.plans.inference import Network
from regweave.session import cut_lineage

MODULE_DEFAULTS = {"p_thresh": 0.05, "rsq_thresh": 0.1, "nvar_thresh": 10}


@dataclass
class ModuleResult:
    modules: DataFrame
    members: DataFrame
    params: dict
    targets: DataFrame | None = None      # gene: the attempted targets


def extract_modules(net: Network, regions: DataFrame | None = None,
                    min_genes_per_module: int = 5, xgb_method: str = "tf", xgb_top: int = 50,
                    **thresholds) -> ModuleResult:
    """Module table and members; parent peaks are added when regions are given."""
    limits = {**MODULE_DEFAULTS, **thresholds}
    table = cut_lineage(modules.find_modules(
        net.coefs, net.gof, net.params["method"], xgb_method=xgb_method, xgb_top=xgb_top,
        **limits))
    members = modules.module_members(table, min_genes_per_module)
    if regions is not None:
        members = members.unionByName(modules.module_peaks(members, regions))
    return ModuleResult(table, members, {
        **limits, "min_genes_per_module": min_genes_per_module}, net.targets)


def attempted_features(net: Network) -> DataFrame:
    """``(feature)``: the targets for which a model was attempted, the default nodes of a graph."""
    return net.targets.select(F.col("gene").alias("feature")).distinct()


def tf_graph(net: Network, edges: DataFrame, tfs: DataFrame, features: DataFrame | None = None,
             **options) -> DataFrame:
    """Subnetwork around each of ``tfs(tf)``; its ends are the attempted targets if no features are given."""
    roots = tfs.select(F.col("tf").alias("root")).distinct()
    return graph.tf_network(edges, roots, attempted_features(net) if features is None else features, **options)


def network_graph(mods: DataFrame | ModuleResult, expression: DataFrame | None = None,
                  obs: DataFrame | None = None, features: DataFrame | None = None,
                  layout: str = "weighted", n_pcs: int = 2, max_iter: int = 100,
                  tol: float = 1e-9, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` with PageRank and, unless ``layout='none'``, coordinates.

    ``weighted`` embeds co-expression weighted by the coefficients, ``corr``
    plain co-expression, ``coef`` the coefficients. Nodes without coordinates
    are dropped, as in an inner join. Without ``features`` the graph is that of
    the attempted targets: those of a result of :func:`extract_modules`, or
    ``targets(gene)`` beside a plain table of modules.
    """
    if layout not in ("weighted", "corr", "coef", "none"):
        raise ValueError("layout must be weighted, corr, coef or none")
    if isinstance(mods, ModuleResult):
        targets = mods.targets if targets is None else targets
        mods = mods.modules
    if features is None and targets is not None:
        features = targets.select(F.col("gene").alias("feature"))
    use = features
    if layout in ("weighted", "corr"):
        measured = expression.select("feature").distinct()
        use = measured if features is None else measured.join(features, "feature", "left_semi")
    kept = mods
    if use is not None:
        for end in ("tf", "target"):
            kept = kept.join(use.select(F.col("feature").alias(end)), end, "left_semi")
    corr = matrix = None
    if layout == "weighted":
        wanted = _grid(kept)
        c = covariance_pairs(expression, expression, wanted.select(
            F.col("tf").alias("x"), F.col("target").alias("y")), obs)
        full = c.select(F.col("x").alias("tf"), F.col("y").alias("target"),
                        clean_correlation(F.col("cor")).alias("corr"))
        corr = full = cut_lineage(full)
        matrix = embedding.weighted_coexpression(full, kept).select(
            F.col("target").alias("gene"), F.col("tf").alias("col"), F.col("coex").alias("value"))
    elif layout == "corr":
        vals = expression.join(use, "feature", "left_semi")
        full = cut_lineage(mirror(correlate(vals, obs)))
        corr = full.select(F.col("x").alias("tf"), F.col("y").alias("target"),
                           F.col("cor").alias("corr"))
        matrix = full.select(F.col("x").alias("gene"), F.col("y").alias("col"),
                             F.col("cor").alias("value"))
    elif layout == "coef":
        matrix = kept.select(F.col("target").alias("gene"), F.col("tf").alias("col"),
                             F.col("estimate").alias("value"))
    nodes, edges = graph.module_graph(kept, corr=corr)
    edges = cut_lineage(edges)
    nodes = nodes.join(graph.pagerank(edges, max_iter=max_iter, tol=tol), "name")
    if matrix is not None:
        pcs = embedding.principal_components(matrix, n_pcs)
        nodes = nodes.join(pcs.withColumnRenamed("gene", "name"), "name")
    return nodes, edges


def _grid(kept: DataFrame, salt: int = 32) -> DataFrame:
    """Every (target, tf) entry of the module matrix: the matrix itself, long."""
    from regweave.functions.columns import all_salts, salt_of
    t = kept.select("target").distinct().withColumn("_s", salt_of("target", buckets=salt))
    f = kept.select("tf").distinct().withColumn("_s", all_salts(salt))
    return t.join(f, "_s").select("target", "tf")
