"""End-to-end network inference as one lineage for all targets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators import design as D
from regweave.operators import models as M
from regweave.operators.assay import aggregate_values, with_group
from regweave.operators.coefficients import attach_correlation, attach_terms
from regweave.operators.correlation import clean_correlation, covariance_pairs
from regweave.operators.links import link_regions
from regweave.operators.packed import Design
from regweave.plans.regions import (
    initiate_regions, measured_tfs, region_accessibility, region_tfs, usable_regions)
from regweave.session import cut_lineage


@dataclass
class Study:
    """Inputs of an inference run; all DataFrames in the library's layouts."""

    expression: DataFrame                    # cell, feature, value
    accessibility: DataFrame                 # cell, feature (peak), value
    cells: DataFrame                         # cell, group columns
    features: DataFrame                      # feature, is_variable (expression assay)
    annotation: DataFrame                    # gene, type, chrom, start, end, strand
    regions: DataFrame | None = None         # region_id, chrom, start, end, peak_id
    motif_hits: DataFrame | None = None      # region_id, motif
    motif_tf: DataFrame | None = None        # motif, tf
    params: dict = field(default_factory=dict)

    def initiate(self, peaks: DataFrame, regions: DataFrame | None = None,
                 exclude_exons: bool = True) -> "Study":
        self.regions = initiate_regions(peaks, self.annotation, regions, exclude_exons)
        self.params["exclude_exons"] = exclude_exons
        return self

    def set_motifs(self, motif_hits: DataFrame, motif_tf: DataFrame) -> "Study":
        self.motif_hits = motif_hits
        self.motif_tf = measured_tfs(motif_tf, self.features)
        if self.motif_tf.isEmpty():
            raise ValueError("none of the TFs in the motif map is measured")
        return self


@dataclass
class Candidates:
    """Everything between the raw inputs and the models."""

    targets: DataFrame          # gene
    links: DataFrame            # target, region_id
    kept_links: DataFrame       # target, region_id, cor
    candidates: DataFrame       # target, region_id, tf
    tf_links: DataFrame         # target, tf, cor (before the cut-off)
    kept_tfs: DataFrame         # target, tf, cor
    pairs: DataFrame            # target, region_id, tf
    expression: DataFrame       # cell (unit), feature, value
    accessibility: DataFrame    # cell (unit), feature (region), value
    obs: DataFrame              # cell (unit)[, weight]


@dataclass
class Network:
    coefs: DataFrame
    gof: DataFrame
    targets: DataFrame
    params: dict


def observation_units(study: Study, rna_col: str | None, peaks_col: str | None):
    """Expression, accessibility and weighted observation units.

    Without grouping a unit is a cell. When both assays are summarised, cells
    with the same pair of groups have identical rows, so each pair is one unit
    weighted by its number of cells. With one summary the other assay keeps
    cells and receives the group value.
    """
    if rna_col is None and peaks_col is None:
        return study.expression, study.accessibility, study.cells.select("cell")

    def summary(values, col):
        return aggregate_values(values, study.cells, [col], "mean").select(
            "grp", "feature", "value")
    cells = study.cells.select("cell")
    if rna_col:
        cells = cells.join(with_group(study.cells, rna_col, check=True)
                           .withColumnRenamed("grp", "gr"), "cell")
    if peaks_col:
        cells = cells.join(with_group(study.cells, peaks_col, check=True)
                           .withColumnRenamed("grp", "gp"), "cell")
    if rna_col and peaks_col:
        unit = F.concat_ws("\u0001", "gr", "gp")
        units = cells.groupBy("gr", "gp").agg(F.count(F.lit(1)).alias("weight"))
        units = units.withColumn("cell", unit)
    else:
        units = cells
    ex, ac = study.expression, study.accessibility
    if rna_col:
        ex = (units.select("cell", F.col("gr").alias("grp"))
              .join(summary(study.expression, rna_col), "grp").select("cell", "feature", "value"))
    if peaks_col:
        ac = (units.select("cell", F.col("gp").alias("grp"))
              .join(summary(study.accessibility, peaks_col), "grp")
              .select("cell", "feature", "value"))
    return ex, ac, units.select("cell", *(["weight"] if "weight" in units.columns else []))


def find_candidates(study: Study, genes: DataFrame | None = None, method: str = "distance",
                    upstream: int = 100_000, downstream: int = 0, extend: int = 1_000_000,
                    only_tss: bool = False, domains: DataFrame | None = None,
                    tf_cor: float = 0.1, peak_cor: float = 0.0,
                    aggregate_rna_col: str | None = None,
                    aggregate_peaks_col: str | None = None) -> Candidates:
    """Candidate (target, region, TF) triples after both correlation screens."""
    if study.motif_hits is None or study.motif_tf is None:
        raise ValueError("motif evidence is missing, set it first")
    ex, ac, obs = observation_units(study, aggregate_rna_col, aggregate_peaks_col)
    targets = D.target_features(study.annotation, study.features, genes)
    gene_rows = study.annotation.join(targets, "gene", "left_semi")
    usable_with_motif = study.regions.join(
        study.motif_hits.select("region_id"), "region_id", "left_semi")
    links = link_regions(usable_with_motif, gene_rows, method, upstream, downstream, extend,
                         only_tss, domains)
    links = links.join(targets, "gene", "left_semi").withColumnRenamed("gene", "target")
    # Interval work is done once; everything below starts from this small table.
    links = cut_lineage(links)
    regions = usable_regions(study.regions, links, study.motif_hits)
    ac = region_accessibility(ac, regions)
    link_cor = covariance_pairs(
        ac, ex, links.select(F.col("region_id").alias("x"), F.col("target").alias("y")), obs)
    link_cor = link_cor.select(F.col("y").alias("target"), F.col("x").alias("region_id"),
                               clean_correlation(F.col("cor")).alias("cor"))
    kept = cut_lineage(D.peak_gene_filter(link_cor, peak_cor))
    cand = cut_lineage(D.candidate_tf_targets(
        kept, region_tfs(study.motif_hits, study.motif_tf)))
    tf_pairs = cand.select(F.col("tf").alias("x"), F.col("target").alias("y")).distinct()
    tf_links = covariance_pairs(ex, ex, tf_pairs, obs).select(
        F.col("y").alias("target"), F.col("x").alias("tf"),
        clean_correlation(F.col("cor")).alias("cor"))
    kept_tfs = cut_lineage(tf_links.filter(F.abs("cor") > tf_cor))
    pairs = cut_lineage(D.model_pairs(cand, kept_tfs))
    return Candidates(targets, links, kept, cand, tf_links, kept_tfs, pairs, ex, ac, obs)


def skipped_targets(study: Study, c: Candidates, genes: DataFrame,
                    network: Network | None = None) -> DataFrame:
    """Why ``genes`` have no model; with the fitted ``network`` also which fits failed."""
    return D.skip_reasons(genes, study.annotation, c.links, c.kept_links, c.candidates, c.pairs,
                          None if network is None else network.gof)


def infer_network(study: Study, genes: DataFrame | None = None, network_name: str | None = None,
                  method: str = "glm", family: str = "gaussian", interaction: str = ":",
                  adjust: str = "fdr", scale: bool = False, fit_options: dict | None = None,
                  count_intercepts: bool = True, **candidate_options) -> Network:
    """Fit one model per target gene and return the named coefficient tables."""
    c = find_candidates(study, genes, **candidate_options)
    options = dict(fit_options or {})
    terms = D.model_terms(c.pairs, interaction)
    if scale:
        if family != "gaussian":
            raise ValueError("a z-transformed response is outside every family but the gaussian")
        base = D.model_terms(c.pairs, "*")
        rows = Design(base, c.expression, c.accessibility, c.obs)
        tables = (base, terms, c.expression, c.accessibility, c.obs)

        def scaling(gram, by):
            return M.scaled_gram(gram, *tables, by=by)
        if method == "xgb":
            rows, zero = M.scaled_rows(D.design_rows(base, *tables[2:]), *tables)
            solution = M.fit_models(rows, c.obs, method, zero=zero, **options)
        elif method in ("cv.glmnet", "bagging_ridge"):
            solution = M.fit_models(rows, c.obs, method, scaling=scaling, **options)
        else:
            solution = M.solve_grams(scaling(M.gram_with_size(rows, c.obs), ()), method, **options)
    else:
        whole = (terms, c.expression, c.accessibility, c.obs)
        # Trees need the rows, all others only their products.
        rows = D.design_rows(*whole) if method == "xgb" else Design(*whole)
        solution = M.fit_models(rows, c.obs, method, family, **options)
    solution = cut_lineage(solution)
    coefs = attach_terms(solution, terms, M.COEF_COLUMNS[method], adjust, count_intercepts)
    coefs = attach_correlation(coefs, c.kept_tfs)
    gof = (solution.filter(F.col("j") == M.GOF_ROW)
           .select("target", *[F.col(f"`{g}`") for g in M.GOF_COLUMNS.get(method, ["rsq"])])
           .join(D.pair_counts(c.pairs), "target"))
    params = {"method": method, "family": family, "interaction": interaction, "scale": scale,
              "network_name": network_name or f"{method}_network", **study.params,
              **{k: v for k, v in candidate_options.items() if not isinstance(v, DataFrame)}}
    return Network(coefs, gof, c.targets, params)

