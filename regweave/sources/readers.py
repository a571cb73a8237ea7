"""Readers for assays, annotation, regions, domains and motif tables.

Every reader returns a lazily scanned DataFrame in the library's layout, so
filters on ``assay``/``layer`` prune partitions and unused columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INTERVAL = ("chrom", "start", "end")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON, CSV or TSV by suffix unless ``fmt`` says otherwise."""
    kind = fmt or path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        opts = {"header": "true", "sep": "," if kind == "csv" else "\t", **options}
        return spark.read.options(**opts).csv(path)
    if kind in ("orc", "json"):
        return spark.read.options(**options).format(kind).load(path)
    return spark.read.options(**options).parquet(path)


def write_assay(values: DataFrame, path: str, mode: str = "append") -> None:
    """``(assay, layer, cell, feature, value)`` partitioned for layer reads."""
    values.filter("value <> 0").write.mode(mode).partitionBy("assay", "layer").parquet(path)


def read_layer(spark: SparkSession, path: str, assay: str | None = None, layer: str = "data",
               slot: str | None = None, default_assay: str = "RNA") -> DataFrame:
    """``(cell, feature, value)`` of one layer; ``slot`` overrides ``layer``."""
    layer = slot if slot is not None else layer
    d = spark.read.parquet(path)
    return (d.filter((F.col("assay") == (assay or default_assay)) & (F.col("layer") == layer))
            .select("cell", "feature", "value"))


def read_features(spark: SparkSession, path: str, assay: str) -> DataFrame:
    return read_table(spark, path).filter(F.col("assay") == assay)


def variable_features(features: DataFrame) -> DataFrame:
    """Default targets; an error when no feature is marked."""
    v = features.filter("is_variable").select(F.col("feature").alias("gene"))
    if v.isEmpty():
        raise ValueError("name the target genes or mark variable features")
    return v


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``(gene, gene_id, type, chrom, start, end, strand)``."""
    d = read_table(spark, path)
    if "gene" not in d.columns and "gene_name" in d.columns:
        d = d.withColumnRenamed("gene_name", "gene")
    return require_annotation(d)


def require_annotation(d: DataFrame | None) -> DataFrame:
    if d is None:
        raise ValueError("a gene annotation is needed")
    missing = [c for c in ("gene", *_INTERVAL) if c not in d.columns]
    if missing:
        raise ValueError(f"annotation lacks {missing}")
    out = d.withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})
    return out if "strand" in d.columns else out.withColumn("strand", F.lit("*"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED is 0-based and half open; the result is 1-based and closed."""
    raw = spark.read.text(path).filter(
        ~F.col("value").rlike(r"^(#|track|browser)") & (F.trim("value") != ""))
    f = F.split("value", r"\s+")
    strand = F.coalesce(F.get(f, 5), F.lit("*"))
    return raw.select(
        F.get(f, 0).alias("chrom"), (F.get(f, 1).cast("bigint") + 1).alias("start"),
        F.get(f, 2).cast("bigint").alias("end"), F.get(f, 3).alias("name"),
        F.when(strand.isin("+", "-"), strand).otherwise("*").alias("strand"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    if path.removesuffix(".gz").endswith(".bed"):
        return read_bed(spark, path)
    return read_table(spark, path).select(
        "chrom", F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Gene domains ``(gene, chrom, start, end, strand)``; several per gene allowed."""
    return read_annotation(spark, path)


def motif_map(table: DataFrame) -> DataFrame:
    """First column is the motif, second the TF; rows with missing names are refused."""
    if len(table.columns) < 2:
        raise ValueError("the motif map needs a motif and a TF column")
    d = table.select(*[F.col(f"`{c}`") for c in table.columns[:2]]).toDF("motif", "tf")
    if not d.filter("motif is null or tf is null").limit(1).isEmpty():
        raise ValueError("the motif map has missing names")
    return d


def read_motif_map(spark: SparkSession, path: str) -> DataFrame:
    return motif_map(read_table(spark, path))


def read_pwms(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path).select(
        "motif", F.col("pos").cast("int").alias("pos"), "base", F.col("score").cast("int"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path).select("chrom", F.col("offset").cast("bigint"), "seq")


def read_cells(spark: SparkSession, path: str, *groups: str) -> DataFrame:
    """Cell metadata; each requested group column must exist and be complete."""
    d = read_table(spark, path)
    for g in groups:
        if g not in d.columns:
            raise ValueError(f"metadata column {g!r} was not found")
    if groups and not d.filter(" or ".join(f"`{g}` is null" for g in groups)).limit(1).isEmpty():
        raise ValueError(f"metadata column in {list(groups)} contains missing values")
    return d
