"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemesh.llm.decontaminate import SPAN, contamination
from tastemesh.llm.html_text import extract
from tastemesh.llm.jaccard_join import classes
from tastemesh.llm.lang_id import identify
from tastemesh.llm.licences import by_document
from tastemesh.llm.mixing import mix
from tastemesh.llm.oracle import ORACLE
from tastemesh.llm.pii import BASE_KINDS, span_text, spans
from tastemesh.llm.quality import quality
from tastemesh.llm.repair import damaged, repair
from tastemesh.llm.sharding import shards
from tastemesh.llm.substrings import remove_repeats
from tastemesh.llm.tables import read
from tastemesh.llm.trie import numbered, rebuilt, trie
from tastemesh.llm.url_filter import judge
from tastemesh.sources.staging import stage


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of benchmark windows found in each document, exactly and by proximity."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), span=SPAN)

    def digest(items: str) -> Column:
        return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda x: x.cast("string")))), 256)

    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", digest("items").alias("items_sha256"), "contaminated",
        F.size("near").cast("long").alias("n_near_items"), digest("near").alias("near_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of each document and whether it is kept under its host's verdict."""
    return quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families confirmed in each document."""
    return by_document(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return identify(read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of passages seen earlier."""
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's url."""
    return judge(read(spark, sf_dir, "pages")).drop("url")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document under links of similar shingle sets."""
    return classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in each document."""
    found = spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(kind: str):
        return lambda s: s["base"] & (s["kind"] == kind)

    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and place of each document, under equal bytes."""
    return shards(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of each damaged conversation."""
    conversations = read(spark, sf_dir, "conversations")
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "of")
    known = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return known.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return trie(*rebuilt(stage(numbered(read(spark, sf_dir, "conversations")), "turns")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_licences, op4_language_id, op5_html_extraction, op6_substring_dedup, op7_url_filters, op8_jaccard_join, op9_mixing, op10_pii,
                             op11_sharding, op12_conversation_repair, op13_prefix_trie)
}

__all__ = ["ORACLE", "QUERIES"]
