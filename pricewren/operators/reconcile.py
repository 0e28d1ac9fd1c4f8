"""Price reconciliation of unit-price segments (rows R1-R4, R7, R8, Q10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricewren import rules
from pricewren.functions import package as K, quality as Q
from pricewren.functions.names import row_id
from pricewren.functions.money import number_text


def choose_price(best: Column, lead: Column) -> Column:
    """Struct of the chosen price and where it came from.

    A computed price within 0.15 of a lead price takes that lead price; without
    a computed price the lead price at the same position is used.
    """
    snap = best["nearest"].isNotNull() & (best["diff"] <= rules.SNAP_PRICE)
    diff = F.when(best["nearest"].isNotNull(), best["diff"])
    computed = F.struct(
        F.when(snap, best["nearest"]).otherwise(best["price"]).alias("price"),
        F.when(best["adjusted"] == 1, F.lit("computed-adjusted-unit-price")).otherwise(F.lit("computed")).alias("source"),
        diff.alias("diff"), best["price"].alias("computed"), best["adjusted"].alias("adjusted"),
        (snap & (best["nearest"] != best["price"])).alias("snapped"),
    )
    nothing = F.lit(None).cast("double")
    from_lead = F.struct(
        lead.alias("price"), F.lit("lead").alias("source"), F.lit(0.0).alias("diff"), nothing.alias("computed"),
        F.lit(0).alias("adjusted"), F.lit(False).alias("snapped"),
    )
    missing = F.struct(
        nothing.alias("price"), F.lit("missing").alias("source"), nothing.alias("diff"), nothing.alias("computed"),
        F.lit(0).alias("adjusted"), F.lit(False).alias("snapped"),
    )
    return F.when(best.isNotNull(), computed).when(lead.isNotNull(), from_lead).otherwise(missing)


def reconcile_segments(segments: DataFrame, page: str = "page_number", prefix: str = "leaflet-") -> DataFrame:
    """R1-R4, R7, R8 and Q10 over the rows of ``extract_unit_segments``."""
    candidates = K.price_candidates(F.col("packageSize"), F.col("unitBase"), F.col("unitPrices"), F.col("leadPrices"))
    chosen = segments.withColumn("_best", K.best_candidate(candidates)).withColumn(
        "_chosen", choose_price(F.col("_best"), F.get("leadPrices", F.col("ordinal")))
    )
    judged = chosen.withColumn(
        "suspectReasons",
        Q.price_safety(
            Q.suspect_price(F.col("_chosen.price"), F.col("unitBase"), F.col("packageSize"), F.col("_chosen.diff")),
            F.col("_chosen.adjusted"), F.col("_chosen.diff"),
        ),
    ).withColumn("suspect", F.size("suspectReasons") > 0)
    unit_price = F.get("unitPrices", F.lit(0))
    return judged.withColumns(
        {
            "price": F.col("_chosen.price"), "unitPrice": unit_price,
            "id": row_id(prefix, F.col("product"), number_text(F.coalesce("_chosen.price", unit_price, F.lit(0.0))),
                         F.col(page), F.col("packageSize")),
            "confidence": Q.segment_confidence(F.col("suspect"), F.col("_chosen.price"), F.col("product"), F.col("_chosen.diff")),
            "debug": F.col("_chosen"),
        }
    ).drop("_best", "_chosen", "leadPrices", "unitPrices")
