"""Linking candidate regions to genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.operators.intervals import extend_intervals, overlap_join, to_tss
from regweave.session import cut_lineage

_REGION = ["region_id", "chrom", "start", "end"]
_GENE = ["gene", "chrom", "start", "end"]


def link_by_distance(regions: DataFrame, genes: DataFrame, upstream: int = 100_000,
                     downstream: int = 0, only_tss: bool = False) -> DataFrame:
    """``(gene, region_id)`` for regions within reach of a gene body or its TSS.

    Applied to every annotation row, so exon-level annotation gives the union
    over a gene's rows.
    """
    g = to_tss(genes) if only_tss else genes
    g = extend_intervals(g, upstream, downstream)
    return (overlap_join(regions.select(*_REGION), g.select(*_GENE))
            .select("gene", "region_id").distinct())


def link_by_domains(regions: DataFrame, domains: DataFrame) -> DataFrame:
    """Links from supplied regulatory domains, used as they are."""
    return (overlap_join(regions.select(*_REGION), domains.select(*_GENE))
            .select("gene", "region_id").distinct())


def link_three_tier(regions: DataFrame, genes: DataFrame, upstream: int = 100_000,
                    downstream: int = 0, extend: int = 1_000_000,
                    basal: str = "body") -> DataFrame:
    """Basal domain first, gene body second, extended domain last.

    A region linked to any gene in one tier is not considered in later tiers.
    ``basal='tss'`` anchors the basal domain at the TSS instead of the whole
    gene. Adds the ``tier`` (1, 2 or 3) that produced the link.
    """
    if basal not in ("body", "tss"):
        raise ValueError("basal must be 'body' or 'tss'")
    regions = regions.select(*_REGION)
    anchor = to_tss(genes) if basal == "tss" else genes
    basal_dom = extend_intervals(anchor, upstream, downstream)
    tiers, open_regions, parts = [
        basal_dom, genes, extend_intervals(basal_dom, extend, extend)], regions, []
    for i, dom in enumerate(tiers, start=1):
        hits = (overlap_join(open_regions, dom.select(*_GENE), min_overlap=2)
                .select("gene", "region_id").distinct())
        # Each tier's hits are read again by the tiers after it.
        hits = cut_lineage(hits)
        parts.append(hits.withColumn("tier", F.lit(i)))
        open_regions = open_regions.join(hits.select("region_id"), "region_id", "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collapse_links(links: DataFrame) -> DataFrame:
    """Number of supporting hits per gene and region (any hit counts as a link)."""
    return links.groupBy("gene", "region_id").agg(F.count(F.lit(1)).alias("n_hits"))


def link_regions(regions: DataFrame, genes: DataFrame, method: str = "distance",
                 upstream: int = 100_000, downstream: int = 0, extend: int = 1_000_000,
                 only_tss: bool = False, domains: DataFrame | None = None,
                 basal: str = "body") -> DataFrame:
    """Dispatch; supplied ``domains`` override the method."""
    if domains is not None:
        return link_by_domains(regions, domains)
    if method == "distance":
        return link_by_distance(regions, genes, upstream, downstream, only_tss)
    if method == "great":
        return link_three_tier(regions, genes, upstream, downstream, extend, basal).drop("tier")
    raise ValueError("method must be 'distance' or 'great'")
