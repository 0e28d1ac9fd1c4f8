"""Serving queries (rows A7-A12, W5, D2-D4 of the inventory)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pricewren.functions.quality import offer_quality, shown_in_mode
from pricewren.functions.text import first_text, normalize_ascii
from pricewren.operators.dedupe import keep_one
from pricewren.operators.enrich import joined_text, present
from pricewren.operators.lines import comparable_value, sort_visible

INFINITY = float("inf")


def quality() -> Column:
    """Q4 over the canonical columns."""
    return offer_quality(F.col("confidence"), F.col("suspect"))


def filter_quality(offers: DataFrame, mode: str = "trusted") -> DataFrame:
    """Q5."""
    return offers.filter(shown_in_mode(quality(), mode))


def filter_stores(offers: DataFrame, stores: DataFrame | Sequence[str]) -> DataFrame:
    """Q7: offers of the selected stores: a short id list or a table of ids."""
    if isinstance(stores, DataFrame):
        return offers.join(stores.select(F.col("id").alias("storeId")).distinct(), "storeId", "left_semi")
    return offers.filter(F.col("storeId").isin(*stores))


def search(offers: DataFrame, text: str) -> DataFrame:
    """Q8: accent-insensitive substring search; an empty query passes all."""
    index = F.col("searchIndex") if "searchIndex" in offers.columns else normalize_ascii(joined_text(offers))
    needle = normalize_ascii(F.lit(text.strip()))
    return offers.filter((needle == "") | F.contains(index, needle))


def comparable_key(offers: DataFrame) -> Column:
    """Key under which offers are compared: T1 of compareKey, else of the name."""
    return normalize_ascii(first_text(*present(offers, ("compareKey", "product"))))


def cheapest_by_key(offers: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """The cheapest offer of every comparable product, first wins ties.

    Only the key, the value and the order columns are sorted and shuffled, at
    most one row per key and map task.
    """
    value = F.coalesce(comparable_value(), F.lit(INFINITY))
    slim = offers.select(comparable_key(offers).alias("key"), value.alias("value"), *dict.fromkeys(["id", *order]))
    return keep_one(slim, ["key"], F.asc("value"), *[F.asc(o) for o in order])


def visible_offers(offers: DataFrame, stores=None, mode: str = "trusted", text: str = "", sort: str = "unitPrice") -> DataFrame:
    """Store, quality and text filters, then the chosen sort."""
    picked = offers if stores is None else filter_stores(offers, stores)
    return sort_visible(search(filter_quality(picked, mode), text), sort)


def cheapest_visible(offers: DataFrame, stores=None, mode: str = "trusted", text: str = "") -> DataFrame:
    """D3: visible offers that are the cheapest of their product.

    The cheapest is decided among all selected and trusted offers, before the
    text query; the query then only has to look at the winners.  One scan, one
    shuffle of at most one row per product and map task, no join back.  One row
    per product; an id that stands for several products wins with each of them.
    """
    picked = filter_quality(offers if stores is None else filter_stores(offers, stores), mode)
    valued = picked.withColumns(
        {"key": comparable_key(picked), "value": F.coalesce(comparable_value(), F.lit(INFINITY))}
    )
    return search(keep_one(valued, ["key"], F.asc("value"), F.asc("id")), text)


def flag_cheapest(offers: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """``isCheapest`` on every row; joined back by id, not ranked per key."""
    best = cheapest_by_key(offers, order).select("id", F.lit(True).alias("isCheapest"))
    return offers.join(best, "id", "left").withColumn("isCheapest", F.coalesce("isCheapest", F.lit(False)))


def quality_counts(offers: DataFrame) -> DataFrame:
    """Offers per quality level."""
    return offers.agg(*[F.count_if(quality() == level).alias(level) for level in ("high", "medium", "low", "suspect")])


def count_by_chain(offers: DataFrame) -> DataFrame:
    """Offers per chain, with the total as the null chain."""
    return offers.rollup("chain").agg(F.count(F.lit(1)).alias("offers"))


def basket_total(items: DataFrame) -> DataFrame:
    """A12."""
    return items.agg(F.sum(F.coalesce("price", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("items"))


def basket_by_store(stores: DataFrame, items: DataFrame) -> DataFrame:
    """Total and item count per store, empty stores included.

    The basket is summed per store before the join.
    """
    totals = items.groupBy("storeId").agg(
        F.sum(F.coalesce("price", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("items")
    )
    return (
        stores.join(totals, stores["id"] == totals["storeId"], "left")
        .select(stores["id"].alias("storeId"), stores["name"].alias("storeName"),
                F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("items", F.lit(0)).alias("items"))
    )
