"""A stored search index (rows Q8, D14 at scale): offers are found by grams, without a scan of their texts.

The index is two tables in one folder.  ``offers`` holds the offers, filed by a hash of the id
into parts and, within these, blocks.  ``grams`` holds for every gram the blocks that have it, once
each and filed by a hash of the gram, so it is far smaller than the texts it indexes.  A query of
length n is covered by about n / 3 grams; it reads the files of their buckets only.  Blocks that
have all of them are looked up in the parts concerned, and there the text itself decides, which is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricewren.functions.text import normalize_ascii
from pricewren.operators.enrich import joined_text
from pricewren.operators.match import grams
from pricewren.session import staged

#: Characters of a gram.
GRAM = 3
#: Blocks of a part.
BLOCKS = 256


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def write_search_index(offers: DataFrame, folder: str, buckets: int = 256) -> None:
    """Build the index of all offers (unique ``id``, and ``searchIndex`` or the fields it is made of).

    ``buckets`` should follow the size: a bucket of each table is read whole.  Crowded
    grams are split over several files of their bucket.
    """
    text = F.col("searchIndex") if "searchIndex" in offers.columns else normalize_ascii(joined_text(offers))
    block = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(BLOCKS)).cast("int")
    filed = offers.withColumns({"searchIndex": text, "block": block, "part": _bucket(F.col("id"), buckets)})
    sorted_ = filed.hint("rebalance", "part").sortWithinPartitions("part", "block")
    sorted_.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/offers")
    # A task reads rows sorted by block: a gram of a block leaves it about once.
    stored = offers.sparkSession.read.schema(sorted_.schema).parquet(f"{folder}/offers")
    found = stored.select("part", "block", F.explode(F.array_distinct(grams(F.col("searchIndex"), GRAM))).alias("gram")).distinct()
    spread = found.withColumn("bucket", _bucket(F.col("gram"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/grams")
    offers.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/size")


def _cover(length: int) -> list[int]:
    """Places of the grams that cover a text of so many characters."""
    return sorted({*range(0, length - GRAM + 1, GRAM), length - GRAM})


def matching_ids(spark: SparkSession, folder: str, queries: list[str]) -> DataFrame:
    """``(query, id)`` of all offers whose search text contains the folded query.

    Queries shorter than a gram are answered from the stored texts.  An empty query
    finds all offers.
    """
    folded = spark.createDataFrame([(q,) for q in queries], "query string").select("query", normalize_ascii("query").alias("f")).collect()
    buckets = spark.read.parquet(f"{folder}/size").first()["buckets"]
    empty = spark.createDataFrame([], "query string, id string")
    short = [r for r in folded if len(r.f) < GRAM]
    long = [r for r in folded if len(r.f) >= GRAM]
    out = []
    if long:
        covers = {r.query: (r.f, sorted({r.f[p : p + GRAM] for p in _cover(len(r.f))})) for r in long}
        rows = [(query, f, gram, len(cover)) for query, (f, cover) in covers.items() for gram in cover]
        wanted = spark.createDataFrame(rows, "query string, f string, gram string, needed int")
        numbers = sorted(r[0] for r in wanted.select(_bucket(F.col("gram"), buckets)).distinct().collect())
        stored = spark.read.parquet(f"{folder}/grams").filter(F.col("bucket").isin(numbers) & F.col("gram").isin(sorted({r[2] for r in rows})))
        hits = stored.join(F.broadcast(wanted), "gram").groupBy("query", "f", "needed", "part", "block").agg(F.count(F.lit(1)).alias("n"))
        blocks = staged(hits.filter("n = needed").select("query", "f", "part", "block"), "blocks")
        parts = sorted(r[0] for r in blocks.select("part").distinct().collect())  # no more than there are buckets
        texts = spark.read.parquet(f"{folder}/offers").filter(F.col("part").isin(parts)).select("id", "searchIndex", "part", "block")
        out.append(texts.join(blocks, ["part", "block"]).filter(F.contains("searchIndex", "f")).select("query", "id"))
    if short:
        table = spark.read.parquet(f"{folder}/offers").select("id", "searchIndex")
        needles = F.array(*[F.struct(F.lit(r.query).alias("query"), F.lit(r.f).alias("f")) for r in short])
        out.append(table.select("id", F.explode(F.filter(needles, lambda q: F.contains("searchIndex", q["f"]))).alias("q")).select("q.query", "id"))
    found = empty.select("query", "id") if not out else out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def search_stored(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Q8 through the index: the offers whose search text contains the query."""
    ids = staged(matching_ids(spark, folder, [text.strip()]).select("id"), "hits")
    buckets = spark.read.parquet(f"{folder}/size").first()["buckets"]
    parts = sorted(r[0] for r in ids.select(_bucket(F.col("id"), buckets)).distinct().collect())  # no more than there are buckets
    offers = spark.read.parquet(f"{folder}/offers").filter(F.col("part").isin(parts))
    return offers.join(ids, "id", "left_semi").drop("part", "block")


def count_stored(spark: SparkSession, folder: str, queries: list[str]) -> DataFrame:
    """D14 through the index: matches of many queries, those without any included."""
    counted = matching_ids(spark, folder, queries).groupBy("query").agg(F.count(F.lit(1)).alias("matches"))
    return spark.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string").join(counted, "query", "left").fillna(0, ["matches"])
