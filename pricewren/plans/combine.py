"""The combine pipeline (rows Q1-Q3, A1, A2, O2, D1 of the inventory)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from pricewren.functions.quality import is_marketing
from pricewren.functions.text import text_of
from pricewren.operators.dedupe import dedupe_last, union_sources
from pricewren.operators.enrich import enrich_offer, normalize_offer
from pricewren.operators.lines import sort_by_store_and_product


def filter_valid(offers: DataFrame) -> DataFrame:
    """Q1: a product name and a price are required."""
    return offers.filter((text_of("product") != "") & F.col("price").isNotNull())


def filter_not_suspect(offers: DataFrame) -> DataFrame:
    """Q2."""
    return offers.filter(~F.coalesce("suspect", F.lit(False)))


def filter_marketing(offers: DataFrame) -> DataFrame:
    """Q3: drop advertising that looks like an offer."""
    context = F.col("rawContext") if "rawContext" in offers.columns else F.lit("")
    description = F.col("description") if "description" in offers.columns else F.lit("")
    return offers.filter(~is_marketing(F.col("product"), description, context))


def keep_where(df: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Filter on derived columns without deriving them again.

    A plain filter is pushed below the projection together with a copy of every
    expression it names; dropping the row in a generator evaluates them once.
    """
    return df.select(F.inline(F.filter(F.array(F.struct(*df.columns)), lambda row: keep(row))))


def prepare_source(offers: DataFrame, name: str | Column) -> DataFrame:
    """One source on its way into the combined table: a chain of narrow steps.

    The cheap tests (price, suspect) run on the scanned columns; the tests on the
    cleaned name run once, after it is derived.
    """
    priced = filter_not_suspect(normalize_offer(offers, name).filter(F.col("price").isNotNull()))
    return keep_where(
        enrich_offer(priced),
        lambda o: (o["product"] != "") & ~is_marketing(o["product"], o["description"], o["rawContext"]),
    )


def combine_offers(sources: Mapping[str, DataFrame], order: tuple[str, ...] = ("sourceOrder", "seq"),
                   sort: bool = False) -> DataFrame:
    """Normalise, enrich, filter and union the sources, last copy wins.

    Every source carries its input order in ``seq``; the sources rank in the
    given order.  One shuffle by offer key; ``sort`` adds a range shuffle of all
    rows, which a sink that is partitioned by chain does not need.
    """
    prepared = [
        prepare_source(df, name).withColumn("sourceOrder", F.lit(position))
        for position, (name, df) in enumerate(sources.items())
    ]
    combined = dedupe_last(union_sources(*prepared), order)
    return sort_by_store_and_product(combined) if sort else combined
