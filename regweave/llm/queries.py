"""Registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regweave.llm import queries_sql
from regweave.llm.alignment import align_tokenizers
from regweave.llm.chat import format_conversations, loss_text
from regweave.llm.decontaminate import benchmark_hits
from regweave.llm.divergence import source_divergence
from regweave.llm.jaccard import similar_documents
from regweave.llm.language import identify_languages
from regweave.llm.licenses import scan_licenses
from regweave.llm.mixing import mix_sources
from regweave.llm.neighbours import nearest
from regweave.llm.quality import classify
from regweave.llm.substring import repeated_spans
from regweave.llm.suffix import remove_repeats

from regweave.llm.warc import new_folder, read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)
    return out.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.size("hits") > 0).alias("contaminated"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(_table(spark, sf_dir, "documents"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("size") * F.col("times")).alias("taken"))


def op7_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_conversations(rows.unionByName(extra))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(loss_text(F.col("turns"))).cast("long").alias("loss_chars"),
        F.sha2(loss_text(F.col("turns")), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar_documents(_table(spark, sf_dir, "documents"), 75, 5)
    return out.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokenizers(_table(spark, sf_dir, "documents"))
    return out.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("alignment", 256)).otherwise("")).drop("alignment")


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    base, found = F.col("base.label"), F.col("detections.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                      F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
                      joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"), "score")


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_quality_classifier, op3_benchmark_decontamination, op4_warc, op5_substring_dedup,
    op6_mixing_sources, op7_approximate_nearest_neighbours, op8_chat_formatting, op9_language_id,
    op10_ngram_jaccard_join, op11_source_divergence_audit, op12_cross_tokenizer_alignment, op13_license_scans)}

ORACLES = {
    "op3_benchmark_decontamination": queries_sql.DECONTAMINATION, "op4_warc": queries_sql.WARC,
    "op5_substring_dedup": queries_sql.SUBSTRINGS, "op8_chat_formatting": queries_sql.CHAT,
    "op10_ngram_jaccard_join": queries_sql.JACCARD, "op11_source_divergence_audit": queries_sql.DIVERGENCE,
}
