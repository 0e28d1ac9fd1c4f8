"""Union, duplicate removal and merging (rows A1-A6, J3, J4 of the inventory).

Keeping one row per key is a rank window with a ``= 1`` filter.  Spark plans a
partial group limit below the shuffle for it, so every map task sends at most
one row per key: a key that holds a third of the table does not become one
huge task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricewren.functions.html import canonical_image_url
from pricewren.functions.text import first_text, normalize_loose, not_blank, text_of

Key = Sequence[Column | str]


def union_sources(*sources: DataFrame) -> DataFrame:
    """A1: all rows of all sources; columns missing in one are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def keep_one(df: DataFrame, key: Key, *order: Column) -> DataFrame:
    """One row per key: the first in ``order``."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def offer_key() -> list[Column]:
    """Identity of a combined offer: store, comparable product, size, prices, page."""
    return [
        F.col("storeId"), first_text("compareKey", "product").alias("_compare"), text_of("packageSize").alias("_size"),
        F.col("price"), F.col("unitPrice"), F.col("pageNumber"),
    ]


def dedupe_last(offers: DataFrame, order: Key, key: Key | None = None) -> DataFrame:
    """A2: the last row (in input order) of every key."""
    return keep_one(offers, key or offer_key(), *[F.desc(o) for o in order])


def dedupe_first(offers: DataFrame, order: Key, key: Key | None = None) -> DataFrame:
    """A3: the first row of every key (text compared in lower case)."""
    default = [F.col("storeId"), F.lower("product"), F.lower(text_of("packageSize")), F.col("price")]
    return keep_one(offers, key or default, *[F.asc(o) for o in order])


def dedupe_best(offers: DataFrame, score: Column | str, order: Key, key: Key | None = None) -> DataFrame:
    """A4: the best-scored row per (page, name, price); the earlier on a tie."""
    default = [F.col("pageNumber"), normalize_loose("product"), F.col("price")]
    ranked = offers.withColumn("_score", F.expr(score) if isinstance(score, str) else score)
    return keep_one(ranked, key or default, F.desc("_score"), *[F.asc(o) for o in order]).drop("_score")


def merge_prefer_key(offers: DataFrame, order: Key, article: str = "klNr") -> DataFrame:
    """A5: one row per product, preferring rows that carry an article number.

    Identity is (name, price, image).  The first row stays unless it lacks the
    article number and a later row has one; that row inherits the first row's
    category where its own is empty.
    """
    identity = [
        F.lower("product").alias("_name"), F.col("price").alias("_price"), canonical_image_url("imageUrl").alias("_image"),
    ]
    has_key = (text_of(article) != "").cast("int")
    sequence = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.struct(*offers.columns)
    merged = offers.groupBy(*identity).agg(
        F.min_by(row, F.struct((1 - has_key).alias("keyless"), sequence.alias("seq"))).alias("_row"),
        F.min_by(text_of("category"), sequence).alias("_first_category"),
    )
    columns = [
        first_text(F.col("_row.category"), "_first_category").alias(c) if c == "category" else F.col(f"_row.{c}").alias(c)
        for c in offers.columns
    ]
    return merged.select(*columns)


def distinct_by(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows by key (any representative)."""
    return df.dropDuplicates(list(keys))


def loose_name() -> Column:
    return normalize_loose("product")


def not_present(candidates: DataFrame, base: DataFrame, name: str = "product") -> DataFrame:
    """Candidates whose folded name does not occur in ``base``.

    Only the distinct names of ``base`` are shuffled.
    """
    known = base.select(normalize_loose(name).alias("_known")).distinct()
    return (
        candidates.withColumn("_name", normalize_loose(name))
        .join(known, F.col("_name") == F.col("_known"), "left_anti")
        .drop("_name")
    )


def new_offers(base: DataFrame, candidates: DataFrame, order: Key) -> DataFrame:
    """Candidates to append: absent from ``base``, first of their name in the batch.

    Equal exact keys imply equal folded names, so one anti join covers both tests.
    One candidate per name is kept first (a map-side limit), so only those meet
    ``base``.  Nameless candidates never collide and are all kept.
    """
    firsts = keep_one(candidates.filter(loose_name() != ""), [loose_name()], *[F.asc(o) for o in order])
    named = not_present(firsts, base.filter(normalize_loose("product") != ""))
    return named.unionByName(candidates.filter(loose_name() == ""))


def append_new(base: DataFrame, candidates: DataFrame, order: Key) -> DataFrame:
    """``base`` plus its new offers."""
    return base.unionByName(new_offers(base, candidates, order), allowMissingColumns=True)


def append_report(base: DataFrame, candidates: DataFrame, order: Key) -> DataFrame:
    """Original / added / skipped / output counts of an append."""
    marked = union_sources(
        base.select(F.lit("base").alias("part")),
        candidates.select(F.lit("candidate").alias("part")),
        new_offers(base, candidates, order).select(F.lit("added").alias("part")),
    )
    counts = marked.agg(*[F.count_if(F.col("part") == p).alias(p) for p in ("base", "candidate", "added")])
    return counts.select(
        F.col("base").alias("original"), "added", (F.col("candidate") - F.col("added")).alias("skipped"),
        (F.col("base") + F.col("added")).alias("output"),
    )
