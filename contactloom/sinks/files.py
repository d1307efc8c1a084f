"""Contact sinks: JSON, CSV, Excel and the site history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import fixed_values as fv
from contactloom.functions.text import md5_prefix
from contactloom.operators.history import new_sites
from contactloom.operators.report import flatten_contacts
from contactloom.sinks.excel import ExcelDataSource
from contactloom.sources.tables import history_source

FORMATS = ("json", "csv", "excel")
OUTPUT_NAMES = ("query_hash", "run_ts")


def run_stamp(spark: SparkSession) -> str:
    """Time stamp of a run, taken once and used in every output name of it."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), fv.RUN_STAMP)).first()[0]


def with_output_names(contacts: DataFrame, stamp: str) -> DataFrame:
    """Partition columns that replace hashed file names."""
    return contacts.withColumn("query_hash", md5_prefix(F.col("query"))).withColumn(
        "run_ts", F.lit(stamp)
    )


def write_json(contacts: DataFrame, path: str, stamp: str | None = None) -> None:
    """JSON lines, nulls written. With a stamp, one folder per query and run."""
    _json(_ordered(contacts, stamp), path)


def write_csv(
    contacts: DataFrame, path: str, stamp: str | None = None, empty_marker: bool = False
) -> None:
    """CSV with header. ``empty_marker`` writes a one-cell file where there are no rows."""
    _csv(_ordered(contacts, stamp), path, empty_marker)


def write_excel(contacts: DataFrame, path: str, stamp: str | None = None) -> None:
    """Workbooks, one or more per query; each task writes its own."""
    _excel(_ordered(contacts, stamp or run_stamp(contacts.sparkSession)), path)


def save(
    contacts: DataFrame,
    folder: str,
    formats: Sequence[str] = FORMATS,
    stamp: str | None = None,
    empty_marker: bool = False,
) -> dict[str, str]:
    """Write the wanted formats from one computation of the result; returns their paths."""
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    ordered = _ordered(contacts, stamp or run_stamp(contacts.sparkSession)).persist()
    paths = {name: f"{folder}/{name}" for name in formats}
    try:
        if "json" in paths:
            _json(ordered, paths["json"])
        if "csv" in paths:
            _csv(ordered, paths["csv"], empty_marker)
        if "excel" in paths:
            _excel(ordered, paths["excel"])
    finally:
        ordered.unpersist()
    return paths


def update_history(crawled: DataFrame, path: str) -> None:
    """Append the sites the history lacks; running it again adds nothing."""
    spark = crawled.sparkSession
    new_sites(crawled, history_source(spark, path)).withColumn(
        "first_seen", F.current_timestamp()
    ).write.mode("append").parquet(path)


def _ordered(contacts: DataFrame, stamp: str | None) -> DataFrame:
    """Result order inside files. Range partitions split a query that is too big for one task.

    Sorting by the partition columns first lets the writers keep this order."""
    if stamp is None:
        return contacts.repartitionByRange("query", "seq").sortWithinPartitions("query", "seq")
    named = with_output_names(contacts, stamp)
    return named.repartitionByRange(*OUTPUT_NAMES, "seq").sortWithinPartitions(*OUTPUT_NAMES, "seq")


def _named_output(ordered: DataFrame) -> bool:
    return set(OUTPUT_NAMES) <= set(ordered.columns)


def _writer(ordered: DataFrame):
    """Saving a run again replaces its own folders (those of its queries and stamp), or the whole
    path where there is no stamp."""
    writer = ordered.write.mode("overwrite")
    if not _named_output(ordered):
        return writer
    return writer.option("partitionOverwriteMode", "dynamic").partitionBy(*OUTPUT_NAMES)


def _json(ordered: DataFrame, path: str) -> None:
    _writer(ordered).option("ignoreNullFields", "false").json(path)


def _csv(ordered: DataFrame, path: str, empty_marker: bool) -> None:
    if empty_marker and ordered.isEmpty():
        marker = ordered.sparkSession.range(1).select(F.lit(fv.EMPTY_MARKER).alias("value"))
        # beside the folders of other runs it is added, alone it replaces the path
        mode = "append" if _named_output(ordered) else "overwrite"
        marker.coalesce(1).write.mode(mode).text(path)
        return
    writer = _writer(flatten_contacts(ordered))
    writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def _excel(ordered: DataFrame, path: str) -> None:
    ordered.sparkSession.dataSource.register(ExcelDataSource)
    rows = flatten_contacts(ordered)
    rows.write.format("contact_excel").mode("append").option("path", path).save()
