"""Helpers shared by the operators: tables, words, ASCII case, shared folders, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.session import shared_folder

#: The white space that separates words, as a character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Mixed into the second of two 64-bit hashes, which together are one 128-bit key.
SECOND_SEED = 0x5EED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are. ASCII strings take the fast built-in way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text without null (an array, empty for an empty text)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def bound(value: Column, function) -> Column:
    """function(value) with value evaluated once, however often the function uses it."""
    return F.get(F.transform(F.array(value), function), 0)


def key128(value: Column) -> list[Column]:
    """Two independent 64-bit hashes of a value, under the names key_a and key_b."""
    return [F.xxhash64(value).alias("key_a"), F.xxhash64(F.lit(SECOND_SEED), value).alias("key_b")]


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal id, modulo divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors see, below spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage is cut and it is computed once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_slices(df: DataFrame, function, schema: str, text: str = "text", slice_bytes: int = 4_000_000) -> DataFrame:
    """mapInArrow by slices of about slice_bytes of a text column (one row at least), so that a task holds little at a time.

    function takes a RecordBatch and returns a Table or RecordBatch of the schema.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, slice_bytes):
                out = function(part)
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > slice_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)
