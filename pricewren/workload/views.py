"""Offers, pages and leaflets expressed on the driver tables.

Each view exists twice: as a DataFrame and as the SQL text that the checking
engine runs on the same parquet files.  Leaflet pages are written *from* the
rows of lineitem, part and supplier (one page per row, no grouping), so every
extraction query grows with the tables and has a known right answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The needed columns of a table."""
    scan = table(spark, sf_dir, name)
    return scan.select(*columns) if columns else scan


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with its narrow rows dealt over the tasks, for pages that are written from it (a small file is read by few tasks)."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))  # without a count the small partitions would be joined again
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(count, "p_partkey")


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part, supplier, nation and region.

    Plain equi joins: the dimensions are broadcast only while they are below the
    session's broadcast threshold.
    """
    t = {n: table(spark, sf_dir, n) for n in ("part", "supplier", "nation", "region")}
    t["lineitem"] = wide_table(
        spark, sf_dir, "lineitem", *LINE_KEY, "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"
    )
    return (
        t["lineitem"]
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )


def row_key() -> Column:
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("-", *parts, F.col("l_shipdate").cast("date").cast("string"))


def offers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as the reference data model sees the driver tables."""
    level = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    return base_rows(spark, sf_dir).select(
        row_key().alias("id"),
        F.col("s_suppkey").cast("string").alias("storeId"),
        F.col("s_name").alias("storeName"),
        F.col("r_name").alias("chain"),
        F.col("p_name").alias("product"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_size").cast("string"), F.lit(" g")).alias("packageSize"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unitPrice"),
        level.alias("confidence"),
        ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).alias("suspect"),
        F.col("l_linenumber").alias("pageNumber"),
        F.col("l_shipdate").cast("date").cast("string").alias("validTo"),
    )


BASE_SQL = """
SELECT l.*, p.*, s.*, n.n_name, r.r_name,
  l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR
    || '-' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS id
FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey
JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey
"""

OFFERS_SQL = f"""
SELECT id, s_suppkey::VARCHAR AS "storeId", s_name AS "storeName", r_name AS chain, p_name AS product,
  p_brand AS brand, p_type AS category, p_size::VARCHAR || ' g' AS "packageSize", l_extendedprice AS price,
  l_extendedprice / l_quantity AS "unitPrice",
  CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence,
  (l_linestatus = 'O' AND l_returnflag = 'R') AS suspect, l_linenumber AS "pageNumber",
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS "validTo"
FROM ({BASE_SQL})
"""


def with_offers(sql: str) -> str:
    """Prefix a query over ``offers`` with the view definition."""
    return f"WITH offers AS ({OFFERS_SQL}) {sql}"


# --- SQL counterparts of the text functions ----------------------------------
def t1(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def t2(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def t3(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '\\s+', ' ', 'g'))"


COMPARE_STOP = "pivo|svetle|svetly|vycepni|lezak|nealkoholicke|nealko|akcni|cena|vybrane|druhy"


def compare_key_sql(product: str, package: str) -> str:
    inner = t1(f"{product} || ' ' || {package}")
    cleaned = f"trim(regexp_replace(regexp_replace({inner}, '\\b({COMPARE_STOP})\\b', ' ', 'g'), ' +', ' ', 'g'))"
    return f"coalesce(nullif({cleaned}, ''), {t1(product)})"


SEARCH_SQL = t1(
    """product || ' ' || brand || ' ' || category || ' ' || "packageSize" || ' ' || "storeName" || ' ' || "storeId" || ' ' || chain"""
)
QUALITY_SQL = "CASE WHEN suspect THEN 'suspect' WHEN confidence IN ('low','medium') THEN confidence ELSE 'high' END"


# --- price rows: lineitem alone, with whole-number prices ---------------------
def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with exact integer prices and a package size."""
    return wide_table(spark, sf_dir, "lineitem", *LINE_KEY, "l_extendedprice").select(
        row_key().alias("id"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("cents"),
        ((F.col("l_partkey") % 50 + 1) * 10).alias("pack"),
        (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11).alias("mix"),
    ).withColumn("unit_cents", F.col("mix") % 2900 + 100)


PRICED_SQL = """
SELECT *, mix % 2900 + 100 AS unit_cents FROM (
 SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR
   || '-' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS id,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents, (l_partkey % 50 + 1) * 10 AS pack,
  l_partkey * 37 + l_suppkey * 11 AS mix FROM lineitem)
"""


def with_prices(sql: str) -> str:
    return f"WITH rows AS ({PRICED_SQL}) {sql}"


def amount_text(cents: Column) -> Column:
    """``1234,05`` from whole cents."""
    return F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def amount_sql(cents: str) -> str:
    return f"(({cents}) // 100)::VARCHAR || ',' || lpad((({cents}) % 100)::VARCHAR, 2, '0')"


# --- pages -------------------------------------------------------------------
NAMED_ENTITIES = (
    ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"),
)


def entities_sql(x: str) -> str:
    for entity, char in NAMED_ENTITIES:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def code_sql(x: str, by: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(?is)<script.*?</script>', '{by}', 'g'), '(?is)<style.*?</style>', '{by}', 'g')"


def strip_tags_sql(x: str) -> str:
    inner = code_sql(x, " ")
    return squeeze_sql("replace(" + entities_sql(f"regexp_replace({inner}, '<[^>]+>', ' ', 'g')") + ", '—', '–')")


def uri_sql(x: str) -> str:
    """Decode percent escapes only when every one of them is well formed."""
    return (
        f"CASE WHEN contains(regexp_replace({x}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') OR NOT contains({x}, '%') THEN {x} "
        f"ELSE url_decode(replace({x}, '+', '%2B')) END"
    )
