"""Windows over page lines, ranks, sorts and top-k (rows W1-W5, O1-O6).

The windows here are partitioned by page: a page is one cell of the input, so a
window never grows with the table.  Running block ids and ordinals work for keys of
any size (``operators.ordered``); so do the global orders as a rank column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricewren.operators.ordered import running_totals, with_ordinal, with_rank

__all__ = [
    "comparable_value", "explode_lines", "page_order", "rank_of", "risk_order", "sort_by_page", "sort_by_risk",
    "sort_by_store_and_product", "sort_visible", "store_and_product_order", "top_k", "top_k_per_group", "visible_order",
    "with_block_id", "with_line_window", "with_neighbours", "with_ordinal", "with_rank",
]

def explode_lines(pages: DataFrame, lines: Column, keep: Sequence[str]) -> DataFrame:
    """One row per line: the kept columns, 0-based ``pos`` and ``line``."""
    return pages.select(*keep, F.posexplode(lines).alias("pos", "line"))


def _page(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def with_neighbours(markers: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """``prev_end`` and ``next_start`` of every marker on its page."""
    window = _page(keys, start)
    return markers.withColumns(
        {"prev_end": F.coalesce(F.lag(end).over(window), F.lit(0)), "next_start": F.lead(start).over(window)}
    )


def with_block_id(lines: DataFrame, keys: Sequence[str], flag: Column, order: str = "pos") -> DataFrame:
    """Running number of the flagged lines (0 before the first one)."""
    return running_totals(lines, keys, [order], {"block": flag.cast("int")})


def with_line_window(lines: DataFrame, keys: Sequence[str], before: int, after: int, separator: str = " ",
                     order: str = "pos") -> DataFrame:
    """``context``, the lines from ``-before`` to ``+after`` joined."""
    window = _page(keys, order).rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(window), separator))


# --- sorts -------------------------------------------------------------------
def comparable_value(unit_price: Column | str = "unitPrice", price: Column | str = "price") -> Column:
    """Unit price, else price; zero counts as missing."""
    return F.coalesce(F.nullif(F.col(unit_price), F.lit(0.0)), F.nullif(F.col(price), F.lit(0.0)))


def visible_order(by: str = "unitPrice", *ties: Column | str) -> list[Column | str]:
    """O1: cheapest first, missing values as 0."""
    value = F.coalesce(F.col("price"), F.lit(0.0)) if by == "price" else F.coalesce(comparable_value(), F.lit(0.0))
    return [value, *(ties or ("id",))]


def store_and_product_order(*ties: Column | str) -> list[Column | str]:
    """O2: store, then product, in Czech collation (Ch sorts after H)."""
    return [F.collate("storeName", "cs"), F.collate("product", "cs"), *ties]


def page_order(*ties: Column | str) -> list[Column | str]:
    """O3: page, then product in Czech collation."""
    return [F.col("pageNumber"), F.collate("product", "cs"), *ties]


def risk_order(risk: str = "risk", count: str = "missing", *ties: Column | str) -> list[Column | str]:
    """High risk first, then the larger count."""
    return [F.desc(rank_of(F.col(risk), {"high": 3, "medium": 2, "low": 1})), F.desc(count), *ties]


def sort_visible(offers: DataFrame, by: str = "unitPrice", *ties: Column | str) -> DataFrame:
    """O1 as a sorted table; ``with_rank`` gives the order as a column."""
    return offers.orderBy(*visible_order(by, *ties))


def sort_by_store_and_product(offers: DataFrame) -> DataFrame:
    """O2 as a sorted table."""
    return offers.orderBy(*store_and_product_order())


def sort_by_page(offers: DataFrame) -> DataFrame:
    """O3 as a sorted table."""
    return offers.orderBy(*page_order())


def rank_of(level: Column, ranks: dict[str, int]) -> Column:
    value = F.lit(0)
    for name, number in ranks.items():
        value = F.when(level == name, F.lit(number)).otherwise(value)
    return value


def sort_by_risk(pages: DataFrame, risk: str = "risk", count: str = "missing") -> DataFrame:
    """O4 as a sorted table."""
    return pages.orderBy(*risk_order(risk, count))


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows (planned as take-ordered, no full sort)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[Column | str], k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows per group; limited map-side before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
