"""The corpus pipeline: each stage works on what the one before kept, written and read again in between.

Rows are followed by ``doc_id`` where it tells all of them apart. Where it does not (null ids, repeated rows, one id with
several texts), a stage works on a staged copy with row numbers, so every row is judged by itself: none is multiplied,
lost for its id, or left with personal data. Columns besides those of ``documents`` are not carried. Null and empty
texts fail the quality rules, very long ones are worked on whole, an empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemesh.llm.decontaminate import contamination
from tastemesh.llm.jaccard_join import classes
from tastemesh.llm.mixing import mix
from tastemesh.llm.pii import redact
from tastemesh.llm.quality import quality
from tastemesh.llm.tables import read
from tastemesh.sources.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``row_id``, a number that no two rows share: ``doc_id`` if it is one."""
    rows = docs.select(*COLUMNS)
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return rows.withColumn("row_id", F.col("doc_id"))
    return stage(rows.withColumn("row_id", F.monotonically_increasing_id()), "rows")


def _by_row(rows: DataFrame) -> DataFrame:
    """The rows under their numbers, as the operators take them."""
    return rows.withColumn("doc_id", F.col("row_id"))


def _kept(rows: DataFrame, judged: DataFrame, verdict: str) -> DataFrame:
    return rows.join(judged.where(verdict).select(F.col("doc_id").alias("row_id")), "row_id", "left_semi").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule leave, and those that break another rule where their host is strict or rejected."""
    rows = numbered(docs)
    return _kept(rows, quality(_by_row(rows)), "NOT base_failed AND (verdict = 'normal' OR NOT broken)")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays: the one with the smallest number."""
    rows = numbered(docs)
    return _kept(rows, classes(_by_row(rows)), "doc_id = component_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    rows = numbered(docs)
    return _kept(rows, contamination(_by_row(rows), read(spark, sf_dir, "benchmark")), "NOT contaminated")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in them is replaced by its kind, and ``n_chars`` follows the text."""
    redacted = redact(numbered(docs), "row_id")
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes, numbered by ``copy``."""
    rows = numbered(docs)
    copies = mix(_by_row(rows)).where("copies > 0").select(
        F.col("doc_id").alias("row_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return rows.join(copies, "row_id").select(*COLUMNS, "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# Hash signatures, model training and rounding have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None
