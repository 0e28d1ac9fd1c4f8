"""Incremental ingestion of leaflet pages (row 2.12 of the inventory).

The extraction operators are plain DataFrame functions, so the same code serves
batch and stream.  New pages arrive as files; every micro batch is extracted,
cut down to offers that the table does not hold yet, and appended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricewren.operators.dedupe import loose_name, new_offers
from pricewren.sources.readers import path_exists
from pricewren.schema import HTML_PAGE

Extract = Callable[[DataFrame], DataFrame]


def page_stream(spark: SparkSession, path: str, schema: T.StructType = HTML_PAGE, pattern: str = "*.parquet",
                files_per_batch: int = 100) -> DataFrame:
    """Pages from a directory of parquet files, in bounded micro batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


BUCKETS = 16


def _bucket() -> Column:
    return F.pmod(F.xxhash64(loose_name()), F.lit(BUCKETS))


def append_batch(target: str, run_id: str, extract: Extract, order: tuple[str, ...] = ("id",)) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: extract, keep new names, write the batch's files.

    Rows are written under ``bucket`` (of the name), ``run`` and ``batch``.  The
    table as it stands, other runs included, is the base of the anti join; only
    the buckets that the batch touches and their names are read.  A batch that is
    replayed after a failure overwrites its own folders and leaves itself out of
    the base, so it leaves the same rows; a run with a fresh checkpoint has a new
    ``run_id`` and overwrites nothing.
    """

    def run(pages: DataFrame, batch: int) -> None:
        spark = pages.sparkSession
        fresh = extract(pages)
        base = spark.createDataFrame([], fresh.schema)
        if path_exists(spark, target):
            touched = [r[0] for r in fresh.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
            kept = T.StructType([*fresh.schema.fields, *(T.StructField(n, t) for n, t in (("bucket", T.LongType()), ("run", T.StringType()), ("batch", T.LongType())))])
            stored = spark.read.schema(kept).parquet(target)
            mine = (F.col("run") == run_id) & (F.col("batch") == batch)
            base = stored.filter(F.col("bucket").isin(touched) & ~mine).select(*fresh.columns)
        rows = new_offers(base, fresh, order).withColumns({"bucket": _bucket(), "run": F.lit(run_id), "batch": F.lit(batch)})
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "run", "batch").parquet(target)

    return run


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the run that owns a checkpoint, made at its first start and stored beside it."""
    path = f"{checkpoint.rstrip('/')}-run"
    if not path_exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.parquet(path)
    return spark.read.schema("run string").parquet(path).first()["run"]


def ingest(pages: DataFrame, target: str, checkpoint: str, extract: Extract, order: tuple[str, ...] = ("id",)) -> StreamingQuery:
    """Start the ingestion over all available pages and stop when they are done."""
    run_id = _run_id(pages.sparkSession, checkpoint)
    writer = pages.writeStream.foreachBatch(append_batch(target, run_id, extract, order)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
