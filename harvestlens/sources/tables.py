"""Catalog tables: scans, views, typed creation, overwrite and append."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestlens.functions.text import to_payload

PREDICTIONS_LOG_DDL = (
    "predicted_at TIMESTAMP, crop_type STRING, state_abbr STRING, state_fips INT, county_fips INT, year INT, "
    "is_irrigated INT, predicted_yield DOUBLE, yield_category STRING, model_version STRING, input_json STRING, "
    "region STRING"
)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scan_any(spark: SparkSession, name: str) -> DataFrame:
    """A table by name; names the catalog call cannot take go through SQL."""
    try:
        return spark.table(name)
    except AnalysisException:
        return spark.sql("SELECT * FROM IDENTIFIER(:t)", args={"t": name})


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def define_views(views: Mapping[str, DataFrame]) -> None:
    """Register a chain of named steps as temp views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def overwrite_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), location: str | None = None) -> None:
    """Replace a table; its schema may change."""
    writer = df.write.mode("overwrite").format("parquet")
    writer = writer.option("path", location) if location else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def ensure_table(
    spark: SparkSession, name: str, columns: str, partitioned_by: tuple[str, ...] = (), location: str | None = None
) -> None:
    """Create a typed Parquet table unless it exists; with a location it is external."""
    parts = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{parts}{place}")


def insert_overwrite(df: DataFrame, name: str) -> None:
    """Replace the contents of an existing table, matching columns by name."""
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name, overwrite=True)


def prediction_log_rows(scored: DataFrame, inputs: list[str], version: str = "1", when: Column | None = None) -> DataFrame:
    """Scored rows in the shape of the audit log: a timestamp and the inputs as JSON text."""
    def known(c, kind):
        value = F.col(c) if c in scored.columns else F.lit(None)
        return F.coalesce(value.cast(kind), F.lit(0).cast(kind)).alias(c)

    def text(c):
        return F.coalesce(F.col(c), F.lit("")).alias(c) if c in scored.columns else F.lit("").alias(c)

    return scored.select(
        (F.current_timestamp() if when is None else when).alias("predicted_at"), text("crop_type"), text("state_abbr"),
        known("state_fips", "int"), known("county_fips", "int"), known("year", "int"), known("is_irrigated", "int"),
        known("predicted_yield", "double"), text("yield_category"), F.lit(version).alias("model_version"),
        to_payload(*inputs).alias("input_json"), text("region"),
    )


def append_predictions(scored: DataFrame, name: str, inputs: list[str], version: str = "1", location: str | None = None) -> None:
    """Append scored rows to the audit log table, creating it at first use."""
    spark = scored.sparkSession
    ensure_table(spark, name, PREDICTIONS_LOG_DDL, location=location)
    rows = prediction_log_rows(scored, inputs, version)
    rows.select(*spark.table(name).columns).write.insertInto(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def can_read(spark: SparkSession, name: str) -> bool:
    """Whether one row of the table can be fetched."""
    try:
        spark.table(name).limit(1).count()
        return True
    except AnalysisException:
        return False


def path_exists(spark: SparkSession, fmt: str, path: str) -> bool:
    """Whether a path holds a readable table of the format."""
    try:
        spark.read.format(fmt).load(path)
        return True
    except AnalysisException:
        return False


def scan_path_sql(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    """Query a path as a table."""
    return spark.sql(f"SELECT * FROM {fmt}.`{path}`")
