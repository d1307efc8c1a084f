"""Input tables. Schemas are explicit, missing optional columns get their defaults."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import schemas
from contactloom.functions.text import md5_prefix
from contactloom.functions.urls import search_url

#: Spark's error conditions for a missing path and for a folder without files.
NO_FILES = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def pages_source(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots; status, content type and fetch time are optional in the files."""
    return with_page_defaults(spark.read.parquet(path))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input is a few small files; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_page_defaults(pages: DataFrame) -> DataFrame:
    defaults = {
        "status": F.lit(200),
        "content_type": F.lit("text/html"),
        "fetched_at": F.lit(None).cast("timestamp"),
    }
    missing = {name: value for name, value in defaults.items() if name not in pages.columns}
    return pages.withColumns(missing) if missing else pages


def listings_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LISTINGS).parquet(path)


def robots_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ROBOTS).parquet(path)


def history_source(spark: SparkSession, path: str) -> DataFrame:
    """Site history, or an empty table where there is none yet.

    Any other failure is raised: taken for "no history" it would let all sites be crawled again.
    """
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in NO_FILES:
            raise
        return spark.createDataFrame([], schemas.HISTORY)
    return found.select("website")


def history_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Import of a history kept as one JSON array of strings."""
    lines = spark.read.text(path, wholetext=True)
    sites = F.from_json("value", "array<string>")
    return lines.select(F.explode(sites).alias("website")).distinct()


def search_plan(queries: DataFrame) -> DataFrame:
    """``query, search_url, query_hash``."""
    return queries.select(
        "query",
        search_url(F.col("query")).alias("search_url"),
        md5_prefix(F.col("query")).alias("query_hash"),
    )
