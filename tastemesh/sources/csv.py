"""CSV and Parquet inputs and outputs with explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemesh.sources import schemas

# A quoted field may hold commas, doubled quotes and blanks at its ends.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False) -> DataFrame:
    """The columns of ``schema`` by the names in the header, in any order and among others.

    A missing column is an error, a value that does not fit its type is NULL. ``line_breaks`` in quoted fields cost
    the splitting of large files.
    """
    # With a null mark that no file holds, only fields left empty are NULL, and quoted empty ones are empty text.
    found = spark.read.options(**CSV_OPTIONS, multiLine=line_breaks, nullValue="\0").csv(path)
    if missing := [f.name for f in schema if f.name not in found.columns]:
        raise ValueError(f"no column {missing!r} in {path}: {found.columns!r}")
    return found.select(*(
        F.col(f.name) if f.dataType == T.StringType() else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog CSV; the list columns are JSON text in the file and arrays in the result."""
    lists = {"genres", "themes"}
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in lists else f.dataType) for f in schemas.CATALOG]
    )
    df = read_csv(spark, path, as_text, line_breaks=True)
    for name in sorted(lists):
        df = df.withColumn(name, F.from_json(name, T.ArrayType(T.StringType())))
    return df.select(*schemas.CATALOG.names)


def read_catalog_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Catalog saved with its lists as arrays."""
    return spark.read.parquet(path).select(*schemas.CATALOG.names)


def write_catalog(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "csv") -> None:
    """Catalog as Parquet with arrays, or as CSV with its lists as JSON text (CSV cannot hold arrays)."""
    if fmt != "csv":
        df.select(*schemas.CATALOG.names).write.mode(mode).format(fmt).save(path)
        return
    out = df.withColumns({c: F.to_json(c) for c in ("genres", "themes")})
    write_csv(out.select(*schemas.CATALOG.names), path, mode)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RATINGS)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LINKS)


def read_history(spark: SparkSession, path: str, rated: bool = False) -> DataFrame:
    return read_csv(spark, path, schemas.RATED_HISTORY if rated else schemas.HISTORY)


def write_history(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """The exported history as Parquet (preferred) or CSV."""
    if fmt == "csv":
        write_csv(df, path, mode)
    else:
        df.write.mode(mode).format(fmt).save(path)


@dataclass(frozen=True)
class Inputs:
    """The three input relations of a study, all lazy."""

    catalog: DataFrame
    ratings: DataFrame
    links: DataFrame


def load_inputs(spark: SparkSession, catalog_path: str, ratings_path: str, links_path: str) -> Inputs:
    return Inputs(
        catalog=read_catalog(spark, catalog_path),
        ratings=read_ratings(spark, ratings_path),
        links=read_links(spark, links_path),
    )
