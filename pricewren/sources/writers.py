"""Writing offers (rows S10-S12 of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

INTERNAL_COLUMNS = ("debug", "sourceOrder", "seq")


def public_columns(offers: DataFrame) -> DataFrame:
    """The offers without debug and bookkeeping columns."""
    return offers.drop(*INTERNAL_COLUMNS)


def write_offers(offers: DataFrame, path: str, version: str, partitions: tuple[str, ...] = ("chain",)) -> str:
    """Write one immutable version of the offers table.

    Versions live next to each other, so an input is never overwritten by the
    job that reads it and the previous version is the backup.  Rows of one chain
    are spread over several files by AQE rather than pulled into one task.
    """
    target = f"{path.rstrip('/')}/version={version}"
    offers.write.mode("errorifexists").partitionBy(*partitions).parquet(target)
    pointer = offers.sparkSession.range(0, 1, 1, 1).select(F.lit(version).alias("version"), F.current_timestamp().alias("writtenAt"))
    pointer.write.mode("append").parquet(_pointers(path))
    return target


def _pointers(path: str) -> str:
    """The small table beside an offers table that tells when each version was finished."""
    return f"{path.rstrip('/')}-versions"


def write_meta(spark: SparkSession, target: str, source: str, path: str) -> DataFrame:
    """One metadata row per written version (source, time, count)."""
    meta = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(source).alias("source"), F.current_timestamp().alias("updatedAt"), "count", F.lit(target).alias("version")
    )
    meta.write.mode("append").parquet(path)
    return meta


def write_json(offers: DataFrame, path: str) -> None:
    """The same rows as JSON lines, for consumers that want text."""
    public_columns(offers).write.mode("errorifexists").json(path)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The version of an offers table that was finished last; only its folder is read."""
    newest = spark.read.schema("version string, writtenAt timestamp").parquet(_pointers(path)).agg(F.max_by("version", "writtenAt")).first()[0]
    return spark.read.parquet(f"{path.rstrip('/')}/version={newest}")
