"""Line dedup over documents (built-in functions only).

Texts are split at line feeds. A line's key is the line without outer white space, with A-Z in lower case; keys
of at least min_length code points that at least min_documents ids share lose all their lines but those in the
smallest id that has the key. The other lines stay in place and are joined again.

Only 128-bit key hashes travel: the ids of a key are combined to (smallest, largest, number) before the shuffle, so a line that all
documents share is one row per task. Shared keys are written as a table; joining it with the lines is a plain equi-join
whose hot keys Spark splits at run time. Positions to drop are gathered per document, never more than its lines.

A null or empty text is one empty line. Rows that share an id are one document; each keeps its own text. Rows
without an id are kept whole and count for no key. Empty tables give empty results. All other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import ascii_lower, key128, staged

STRIPPED = " \t\n\x0b\x0c\r"


def line_keys(docs: DataFrame, id_col: str, text: str, min_length: int) -> DataFrame:
    """One row per line with a long enough key: id, t_a (hash of the text), at (0-based position), key_a, key_b."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("t_a"), F.posexplode(lines).alias("at", "line")
    )
    rows = rows.withColumn("line", F.btrim("line", F.lit(STRIPPED))).where(F.length("line") >= min_length)
    return rows.withColumn("line", ascii_lower(F.col("line"))).select("id", "t_a", "at", *key128(F.col("line")))


def shared_keys(keys: DataFrame, min_documents: int) -> DataFrame:
    """key_a, key_b and the smallest id of the keys that at least min_documents ids have."""
    if min_documents == 2:  # the largest id then tells as much as the number, at less cost
        found = keys.groupBy("key_a", "key_b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        each = keys.select("key_a", "key_b", "id").distinct()
        found = each.groupBy("key_a", "key_b").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_documents)
    return found.select("key_a", "key_b", "first")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = 10, min_documents: int = 2
) -> DataFrame:
    """docs with the text replaced by its kept lines, and the columns n_lines and n_dropped."""
    keys = line_keys(docs, id_col, text, min_length)
    shared = staged(shared_keys(keys, min_documents))
    dropped = keys.join(shared, ["key_a", "key_b"]).where("id <> first").groupBy("id", "t_a").agg(F.collect_set("at").alias("__drop"))
    dropped = dropped.withColumnsRenamed({"id": "__id", "t_a": "__t_a"})
    rows = docs.withColumn("__hash", F.xxhash64(F.col(text)))
    rows = rows.join(dropped, (rows[id_col] == F.col("__id")) & (F.col("__hash") == F.col("__t_a")), "left")
    lines = F.split(F.coalesce(rows[text], F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.array_join(F.transform(stay, lambda at: F.get(F.col("__lines"), at)), "\n")
    rows = rows.withColumn("__lines", lines)
    out = {"__kept": F.when(F.col("__drop").isNull(), F.coalesce(rows[text], F.lit(""))).otherwise(kept)}
    rows = rows.withColumns(out)
    return rows.select(
        *[F.col("__kept").alias(c) if c == text else docs[c] for c in docs.columns],
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
    )
