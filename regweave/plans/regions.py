"""Candidate regions and motif evidence: the first two steps of a study."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regweave.functions.columns import region_name, split_region
from regweave.operators.intervals import (
    merge_intervals, overlap_join, pair_intersection, subtract_intervals, within_one)
from regweave.session import cut_lineage


def peak_table(features: DataFrame, column: str = "feature", sep=("-", "-")) -> DataFrame:
    """Peak intervals parsed from accessibility feature names."""
    named = features.select(F.col(column).alias("peak_id"))
    return split_region(named, "peak_id", sep)


def candidate_regions(peaks: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Parts of peaks covered by the supplied regions; all peaks when none are given.

    Equal regions leave equal parts, so each is joined once. Of the regions that leave
    the same part of a peak, the pair of one is kept, so the pairs need not be compared:
    the last start of those that end together and start before the peak, the first end
    of those that start together and end behind it. Whole peaks are found without pairs.
    """
    peaks = peaks.select("peak_id", "chrom", "start", "end")
    if regions is None:
        return peaks
    spans = cut_lineage(peaks.distinct().withColumn("spans", F.count(F.lit(1)).over(W.partitionBy("peak_id"))))
    marked = cut_lineage(
        regions.select("chrom", "start", "end").distinct()
        .withColumn("next_start", F.lead("start").over(W.partitionBy("chrom", "end").orderBy("start")))
        .withColumn("prev_end", F.lag("end").over(W.partitionBy("chrom", "start").orderBy("end"))))
    one = spans.filter("spans = 1").drop("spans")
    pairs = overlap_join(one, marked).filter(
        "(r_start > l_start or r_end < l_end)"
        " and (r_start > l_start or next_start is null or next_start > l_start)"
        " and (r_end < l_end or prev_end is null or prev_end < l_end)").drop("next_start", "prev_end")
    parts = pair_intersection(pairs).unionByName(within_one(one, marked.select("chrom", "start", "end")))
    more = spans.filter("spans > 1").drop("spans")      # equal parts may come from several spans of a peak
    if not more.isEmpty():
        parts = parts.unionByName(pair_intersection(overlap_join(more, marked.select("chrom", "start", "end"))).distinct())
    return parts


def initiate_regions(peaks: DataFrame, annotation: DataFrame,
                     regions: DataFrame | None = None,
                     exclude_exons: bool = True) -> DataFrame:
    """``regions(region_id, chrom, start, end, peak_id)``.

    The parent peak is carried through every step instead of being looked up
    again by position, so a region lying in two peaks keeps the right one.
    """
    cand = candidate_regions(peaks, regions)
    if exclude_exons:
        exons = merge_intervals(
            annotation.filter(F.col("type") == "exon").select("chrom", "start", "end"))
        cand = cand.withColumn("cand_id", F.concat_ws("|", "peak_id", "start", "end"))
        cand = subtract_intervals(cand, exons, "cand_id").drop("cand_id")
    # Two supplied regions may leave the same piece of one peak.
    return (cand.select("chrom", "start", "end", "peak_id").distinct()
            .withColumn("region_id", region_name())
            .select("region_id", "chrom", "start", "end", "peak_id"))


def measured_tfs(motif_tf: DataFrame, features: DataFrame) -> DataFrame:
    """Motif-to-TF map restricted to TFs present in the expression assay."""
    return (motif_tf.select("motif", "tf").distinct()
            .join(features.select(F.col("feature").alias("tf")), "tf", "left_semi")
            .select("motif", "tf"))


def region_tfs(motif_hits: DataFrame, motif_tf: DataFrame) -> DataFrame:
    """TFs with at least one motif in a region, matched by motif name."""
    return (motif_hits.select("region_id", "motif").distinct()
            .join(motif_tf.select("motif", "tf").distinct(), "motif")
            .select("region_id", "tf").distinct())


def usable_regions(regions: DataFrame, links: DataFrame, motif_hits: DataFrame) -> DataFrame:
    """Regions near at least one target gene that also carry a motif."""
    return (regions.join(links.select("region_id"), "region_id", "left_semi")
            .join(motif_hits.select("region_id"), "region_id", "left_semi"))


def region_accessibility(values: DataFrame, regions: DataFrame) -> DataFrame:
    """Give every region the accessibility of its parent peak."""
    return (values.withColumnRenamed("feature", "peak_id")
            .join(regions.select("region_id", "peak_id"), "peak_id")
            .select("cell", F.col("region_id").alias("feature"), "value"))
