"""Queries over the offers view: serving, quality, enrichment, aggregation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricewren.functions import html as H, quality as Q, text as T
from pricewren.functions.names import clean_product_name, row_id
from pricewren.operators import dedupe, enrich, lines, match, ordered
from pricewren.plans import index, serve
from pricewren.session import shared_folder
from pricewren.workload.registry import query
from pricewren.workload.views import (
    QUALITY_SQL, SEARCH_SQL, base_rows, compare_key_sql, offers_view, t1, t3, table, with_offers,
)

TRUSTED = f"({QUALITY_SQL}) IN ('high','medium')"
KEY_SQL = compare_key_sql("product", '"packageSize"')


def keyed_offers(spark, sf):
    return offers_view(spark, sf).withColumn("compareKey", enrich.compare_key(F.col("product"), F.col("packageSize")))


# --- flagship ----------------------------------------------------------------
CHEAPEST_SQL = with_offers(f"""
, keyed AS (SELECT *, {KEY_SQL} AS key, coalesce(nullif("unitPrice", 0), nullif(price, 0), 'Infinity'::DOUBLE) AS value
  FROM offers WHERE {TRUSTED})
SELECT id, key, value, "storeId", chain, product, "packageSize"
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value, id) AS rn FROM keyed) WHERE rn = 1
""")


@query("cheapest_visible", CHEAPEST_SQL)
def cheapest_visible(spark, sf):
    """For each comparable product, which trusted offer is cheapest per unit?"""
    return serve.cheapest_visible(keyed_offers(spark, sf)).select(
        "id", "key", "value", "storeId", "chain", "product", "packageSize"
    )


@query("cheapest_by_key", with_offers(f"""
SELECT key, min(value) AS value, arg_min(id, (value, id)) AS id FROM
 (SELECT {KEY_SQL} AS key, coalesce(nullif("unitPrice", 0), nullif(price, 0), 'Infinity'::DOUBLE) AS value, id FROM offers)
GROUP BY key"""))
def cheapest_by_key(spark, sf):
    return serve.cheapest_by_key(keyed_offers(spark, sf)).select("key", "value", "id")


@query("flag_cheapest", with_offers(f"""
SELECT id, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY coalesce(nullif("unitPrice", 0), nullif(price, 0)), id) = 1
 AS "isCheapest" FROM offers"""))
def flag_cheapest(spark, sf):
    return serve.flag_cheapest(keyed_offers(spark, sf)).select("id", "isCheapest")


@query("visible_offers", with_offers(f"""
SELECT id, product, price FROM offers
WHERE ("storeId"::BIGINT % 3 = 0) AND {TRUSTED} AND contains({SEARCH_SQL}, 'red widget')"""))
def visible_offers(spark, sf):
    stores = table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("id"))
    return serve.visible_offers(offers_view(spark, sf), stores, "trusted", " Réd  WIDGET").select("id", "product", "price")


@query("search", with_offers(f"SELECT id, product FROM offers WHERE contains({SEARCH_SQL}, 'blue bolt brand 4')"))
def search(spark, sf):
    return serve.search(offers_view(spark, sf), "Blue-Bolt Brand#4").select("id", "product")


def _stored_index(spark, sf):
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.write_search_index(enrich.with_search_index(offers_view(spark, sf)).select("id", "product", "searchIndex"), folder, buckets=64)
    return folder


@query("search_stored", with_offers(f"SELECT id, product FROM offers WHERE contains({SEARCH_SQL}, 'blue bolt brand 4')"))
def search_stored(spark, sf):
    """Q8 through a stored index."""
    return index.search_stored(spark, _stored_index(spark, sf), "Blue-Bolt Brand#4").select("id", "product")


@query("count_stored", with_offers(f"""
, q(query, f) AS (VALUES ('Blue-Bolt', 'blue bolt'), ('brand 2', 'brand 2'), ('8', '8'), ('no such product', 'no such product'))
SELECT query, (SELECT count(*) FROM offers WHERE contains({SEARCH_SQL}, f)) AS matches FROM q"""))
def count_stored(spark, sf):
    """Many queries served by one index."""
    return index.count_stored(spark, _stored_index(spark, sf), ["Blue-Bolt", "brand 2", "8", "no such product"])


@query("search_index", with_offers(f'SELECT id, {SEARCH_SQL} AS "searchIndex" FROM offers'))
def search_index(spark, sf):
    return enrich.with_search_index(offers_view(spark, sf)).select("id", "searchIndex")


@query("filter_stores", with_offers("""
SELECT id, "storeId" FROM offers WHERE "storeId" IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 5000)"""))
def filter_stores(spark, sf):
    stores = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("id"))
    return serve.filter_stores(offers_view(spark, sf), stores).select("id", "storeId")


@query("filter_quality_modes", with_offers(f"""
SELECT mode, count(*) AS offers FROM (SELECT {QUALITY_SQL} AS q FROM offers) JOIN
 (VALUES ('all','high'),('all','medium'),('all','low'),('all','suspect'),('high','high'),('review','low'),
  ('review','suspect'),('trusted','high'),('trusted','medium')) m(mode, level) ON q = level GROUP BY mode"""))
def filter_quality_modes(spark, sf):
    offers = offers_view(spark, sf)
    modes = F.array(*[
        F.when(Q.shown_in_mode(serve.quality(), mode), F.lit(mode)) for mode in ("all", "high", "review", "trusted")
    ])
    shown = offers.select(F.explode(F.array_compact(modes)).alias("mode"))
    return shown.groupBy("mode").agg(F.count(F.lit(1)).alias("offers"))


@query("offer_quality", with_offers(f"""
SELECT id, {QUALITY_SQL} AS quality, CASE {QUALITY_SQL} WHEN 'high' THEN 'vysoká jistota' WHEN 'medium' THEN 'střední jistota'
 WHEN 'low' THEN 'nízká jistota' ELSE 'ke kontrole' END AS label FROM offers"""))
def offer_quality(spark, sf):
    return offers_view(spark, sf).select("id", serve.quality().alias("quality"), Q.quality_label(serve.quality()).alias("label"))


@query("quality_counts", with_offers(f"""
SELECT count(*) FILTER (WHERE q = 'high') AS high, count(*) FILTER (WHERE q = 'medium') AS medium,
 count(*) FILTER (WHERE q = 'low') AS low, count(*) FILTER (WHERE q = 'suspect') AS suspect
FROM (SELECT {QUALITY_SQL} AS q FROM offers)"""))
def quality_counts(spark, sf):
    return serve.quality_counts(offers_view(spark, sf))


@query("count_by_chain", with_offers("SELECT chain, count(*) AS offers FROM offers GROUP BY ROLLUP (chain)"))
def count_by_chain(spark, sf):
    return serve.count_by_chain(offers_view(spark, sf))


@query("count_by_page", with_offers("""
SELECT "pageNumber", count(*) AS offers, count(DISTINCT "storeId") AS stores FROM offers GROUP BY "pageNumber" """))
def count_by_page(spark, sf):
    return offers_view(spark, sf).groupBy("pageNumber").agg(
        F.count(F.lit(1)).alias("offers"), F.countDistinct("storeId").alias("stores")
    )


# --- baskets -----------------------------------------------------------------
@query("basket_by_store", """
SELECT s_suppkey::VARCHAR AS "storeId", s_name AS "storeName", round(coalesce(sum(l_extendedprice), 0), 2) AS total,
 count(l_orderkey) AS items
FROM supplier LEFT JOIN (SELECT l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%')
 ON l_suppkey = s_suppkey GROUP BY ALL""")
def basket_by_store(spark, sf):
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority").startswith("1"))
    cart = table(spark, sf, "lineitem").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"))
    items = cart.select(F.col("l_suppkey").cast("string").alias("storeId"), F.col("l_extendedprice").alias("price"))
    stores = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return serve.basket_by_store(stores, items).withColumn("total", F.round("total", 2))


@query("basket_total", """
SELECT round(sum(coalesce(l_extendedprice, 0)), 2) AS total, count(*) AS items FROM lineitem WHERE l_linestatus = 'O'""")
def basket_total(spark, sf):
    items = table(spark, sf, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_extendedprice").alias("price"))
    return serve.basket_total(items).withColumn("total", F.round("total", 2))


@query("join_stores", """
SELECT s_suppkey::VARCHAR AS "storeId", count(*) AS offers, max(s_name) AS name, max(n_name) AS address
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY s_suppkey""")
def join_stores(spark, sf):
    stores = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    stores = stores.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("address"))
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("storeId"))
    return match.join_stores(items, stores).groupBy("storeId").agg(
        F.count(F.lit(1)).alias("offers"), F.max("store_name").alias("name"), F.max("store_address").alias("address")
    )


# --- enrichment --------------------------------------------------------------
@query("canonical_store_id", """
SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'c' || (l_suppkey % 7)::VARCHAR ELSE l_suppkey::VARCHAR END AS "storeId", count(*) AS offers
FROM lineitem GROUP BY 1""")
def canonical_store_id(spark, sf):
    aliases = table(spark, sf, "supplier").filter("s_suppkey % 5 = 0").selectExpr(
        "cast(s_suppkey as string) as alias", "concat('c', s_suppkey % 7) as id"
    )
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("storeId"))
    return enrich.canonical_store_id(items, aliases).groupBy("storeId").agg(F.count(F.lit(1)).alias("offers"))


@query("normalize_offer", with_offers("""
SELECT id, "storeId", product, price, coalesce("unitPrice", price) AS "unitPrice", 'Kč/ks' AS unit, 'akce' AS "priceType",
 product AS "imageAlt", confidence, suspect, '' AS description, 'feed one' AS "sourceFile" FROM offers"""))
def normalize_offer(spark, sf):
    return enrich.normalize_offer(offers_view(spark, sf), "feed one").select(
        "id", "storeId", "product", "price", "unitPrice", "unit", "priceType", "imageAlt", "confidence", "suspect",
        "description", "sourceFile",
    )


@query("compare_key", with_offers(f"SELECT DISTINCT product, \"packageSize\", {KEY_SQL} AS key FROM offers"))
def compare_key(spark, sf):
    return keyed_offers(spark, sf).select("product", "packageSize", F.col("compareKey").alias("key")).distinct()


@query("search_terms", with_offers("""
SELECT id, product || ' ' || brand || ' ' || p1 || ' g ' || chain || ' ' || "storeName" AS terms FROM
 (SELECT *, split_part("packageSize", ' ', 1) AS p1 FROM offers)"""))
def search_terms(spark, sf):
    cols = [F.col(c) for c in ("product", "brand", "packageSize", "chain", "storeName", "chain", "product")]
    return offers_view(spark, sf).select("id", enrich.search_terms(*cols).alias("terms"))


PAGE_RANGE_SQL = " ".join(
    f"WHEN p BETWEEN {a} AND {b} THEN '{c}'" for a, b, c, _ in __import__("pricewren.rules", fromlist=["x"]).PAGE_CATEGORIES
)


@query("category_by_page_range", f"""
SELECT p AS page, CASE {PAGE_RANGE_SQL} ELSE '' END AS category, count(*) AS parts FROM
 (SELECT CAST(p_size AS INTEGER) AS p FROM part) GROUP BY ALL""")
def category_by_page_range(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_size").alias("page"), F.col("p_name").alias("product"))
    tagged = parts.withColumn("category", enrich.category_by_page_range(F.col("page"), F.col("product")))
    return tagged.groupBy("page", "category").agg(F.count(F.lit(1)).alias("parts"))


@query("category_by_ranges", """
WITH ranges AS (SELECT n_nationkey * 2 AS f, n_nationkey * 2 + 2 AS t, n_name AS category FROM nation)
SELECT id, category AS "rangeCategory" FROM (
 SELECT l_orderkey::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, p_size FROM lineitem JOIN part ON l_partkey = p_partkey) o
LEFT JOIN (SELECT page, arg_min(category, (f, category)) AS category FROM
 (SELECT unnest(generate_series(f, t)) AS page, f, category FROM ranges) GROUP BY page) ON page = p_size""")
def category_by_ranges(spark, sf):
    ranges = table(spark, sf, "nation").selectExpr("n_nationkey * 2 as `from`", "n_nationkey * 2 + 2 as `to`", "n_name as category")
    items = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = items.selectExpr("concat_ws('-', l_orderkey, l_partkey, l_linenumber) as id", "p_size as pageNumber")
    return enrich.category_by_ranges(items, ranges).select("id", "rangeCategory")


WIDE_RANGES_SQL = """
WITH ranges AS (SELECT s_suppkey * 40000 AS f, s_suppkey * 40000 + s_nationkey * 300000 AS t, s_name AS category FROM supplier
 UNION ALL SELECT 0, 3000000, 'early' UNION ALL SELECT 7, 7, 'seven' UNION ALL SELECT 9, 8, 'reversed'),
o AS (SELECT o_orderkey AS id, o_orderkey * 97 AS page FROM orders)"""


@query("category_by_wide_ranges", WIDE_RANGES_SQL + """
SELECT id, category AS "rangeCategory" FROM (SELECT o.id, r.category, row_number() OVER (PARTITION BY o.id ORDER BY r.f NULLS LAST, r.category) AS n
 FROM o LEFT JOIN ranges r ON page BETWEEN f AND t) WHERE n = 1""")
def category_by_wide_ranges(spark, sf):
    """E8 with ranges of up to millions of pages that overlap."""
    ranges = table(spark, sf, "supplier").selectExpr(
        "s_suppkey * 40000L as `from`", "s_suppkey * 40000L + s_nationkey * 300000L as `to`", "s_name as category"
    ).unionByName(spark.createDataFrame([(0, 3_000_000, "early"), (7, 7, "seven"), (9, 8, "reversed")], "from long, to long, category string"))
    pages = table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_orderkey * 97 as pageNumber")
    return enrich.category_by_ranges(pages, ranges).select("id", "rangeCategory")


DICTIONARY = (("fastening", ("bolt", "screw")), ("colour", ("red", "blue")), ("small goods", ("small",)))


@query("tag_by_dictionary", f"""
SELECT p_partkey AS id, CASE WHEN regexp_matches({t3('p_name')}, 'bolt|screw') THEN 'fastening'
 WHEN regexp_matches({t3('p_name')}, 'red|blue') THEN 'colour' WHEN contains({t3('p_name')}, 'small') THEN 'small goods'
 ELSE 'other' END AS tag FROM part""")
def tag_by_dictionary(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), enrich.tag_by_dictionary(T.normalize_loose("p_name"), DICTIONARY, "other").alias("tag")
    )


@query("image_audit", """
SELECT page_id, len(regexp_extract_all(html, '<a ')) > 0 AS has_link, 'imageUrl' AS fields FROM pages""")
def image_audit(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("imageUrl"), F.lit("").alias("thumbnail"), "html"
    )
    return enrich.image_audit(pages).select(
        "page_id", F.contains("html", F.lit("<a ")).alias("has_link"), F.array_join(F.map_keys("imageFields"), ",").alias("fields")
    )


@query("first_image_url", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'page-' || page_id::VARCHAR END AS image FROM pages""")
def first_image_url(spark, sf):
    pages = table(spark, sf, "pages").selectExpr(
        "page_id", "if(page_id % 3 = 0, url, '') as imageUrl", "cast(null as string) as image2", "concat('page-', page_id) as pageImageUrl"
    )
    return pages.select("page_id", H.first_image_url("imageUrl", "image2", "pageImageUrl").alias("image"))


# --- filters -----------------------------------------------------------------
@query("filter_valid", with_offers("""
SELECT id FROM (SELECT id, CASE WHEN "pageNumber" = 3 THEN NULL ELSE price END AS price,
 CASE WHEN confidence = 'low' THEN '' ELSE product END AS product, suspect FROM offers)
WHERE product <> '' AND price IS NOT NULL AND NOT suspect"""))
def filter_valid(spark, sf):
    from pricewren.plans.combine import filter_not_suspect, filter_valid

    broken = offers_view(spark, sf).withColumns({
        "price": F.when(F.col("pageNumber") != 3, F.col("price")),
        "product": F.when(F.col("confidence") == "low", F.lit("")).otherwise(F.col("product")),
    })
    return filter_not_suspect(filter_valid(broken)).select("id")


@query("is_chain", with_offers("""SELECT chain, count(*) AS offers FROM offers WHERE lower(chain) LIKE '%asia%' GROUP BY chain"""))
def is_chain(spark, sf):
    offers = offers_view(spark, sf)
    fields = enrich.present(offers, ("chain", "storeName", "storeId", "source", "sourceName"))
    return offers.filter(Q.is_chain("Ásia", *fields)).groupBy("chain").agg(F.count(F.lit(1)).alias("offers"))


@query("prefix_lists", """
SELECT p_partkey AS id FROM part WHERE (starts_with(lower(p_name), 'red') OR starts_with(lower(p_name), 'small'))
 AND NOT starts_with(lower(p_name), 'small ring')""")
def prefix_lists(spark, sf):
    parts = table(spark, sf, "part")
    allowed = Q.starts_with_any(F.col("p_name"), ("Réd", "SMALL")) & ~Q.starts_with_any(F.col("p_name"), ("small ring",))
    return parts.filter(allowed).select(F.col("p_partkey").alias("id"))


@query("row_id", with_offers("""
SELECT id, 'offer-' || substr(sha1(product || '|' || "packageSize" || '|' || "pageNumber"::VARCHAR), 1, 16) AS row_id FROM offers"""))
def row_id_query(spark, sf):
    return offers_view(spark, sf).select(
        "id", row_id("offer-", F.col("product"), F.col("packageSize"), F.col("pageNumber")).alias("row_id")
    )


@query("clean_product_name", """
SELECT p_partkey AS id, p_name AS product FROM part""")
def clean_name(spark, sf):
    noisy = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Kuchyně ", "AKČNÍ NABÍDKA  ", " nastylujte ", "TR  O ", "")]),
                              (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_name")).alias("raw"),
    )
    return noisy.select("id", clean_product_name("raw").alias("product"))


# --- duplicates --------------------------------------------------------------
@query("dedupe_last", with_offers(f"""
SELECT id, "storeId", product FROM (SELECT *, row_number() OVER (PARTITION BY "storeId", {KEY_SQL}, "packageSize",
 "pageNumber" ORDER BY id DESC) AS rn FROM offers) WHERE rn = 1"""))
def dedupe_last(spark, sf):
    key = ["storeId", "compareKey", "packageSize", "pageNumber"]
    return dedupe.dedupe_last(keyed_offers(spark, sf), ["id"], key).select("id", "storeId", "product")


@query("dedupe_last_full_key", with_offers(f"""
SELECT max(id) AS id FROM offers GROUP BY "storeId", {KEY_SQL}, "packageSize", price, "unitPrice", "pageNumber" """))
def dedupe_last_full_key(spark, sf):
    return dedupe.dedupe_last(keyed_offers(spark, sf), ["id"]).select("id")


@query("dedupe_first", with_offers("""
SELECT id, product FROM (SELECT *, row_number() OVER (PARTITION BY chain, lower(product), lower("packageSize") ORDER BY id) AS rn
 FROM offers) WHERE rn = 1"""))
def dedupe_first(spark, sf):
    key = ["chain", F.lower("product"), F.lower("packageSize")]
    return dedupe.dedupe_first(offers_view(spark, sf), ["id"], key).select("id", "product")


@query("dedupe_best", with_offers(f"""
SELECT id, product, "pageNumber" FROM (SELECT *, row_number() OVER (PARTITION BY "pageNumber", {t3('product')}, category
 ORDER BY "unitPrice" DESC, id) AS rn FROM offers) WHERE rn = 1"""))
def dedupe_best(spark, sf):
    key = ["pageNumber", T.normalize_loose("product"), "category"]
    return dedupe.dedupe_best(offers_view(spark, sf), F.col("unitPrice"), ["id"], key).select("id", "product", "pageNumber")


@query("merge_prefer_key", """
WITH o AS (SELECT p_partkey AS seq, p_name AS product, CAST(p_size % 4 AS DOUBLE) AS price,
  'http://x/' || p_type || '.jpg?v=' || p_partkey::VARCHAR AS img, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE '' END AS kl,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS category FROM part),
g AS (SELECT *, row_number() OVER (PARTITION BY lower(product), price, split_part(img, '?', 1) ORDER BY (kl = '')::INT, seq) AS rn,
  first_value(category) OVER (PARTITION BY lower(product), price, split_part(img, '?', 1) ORDER BY seq) AS fc FROM o)
SELECT seq, product, price, kl AS "klNr", CASE WHEN category <> '' THEN category ELSE fc END AS category FROM g WHERE rn = 1""")
def merge_prefer_key(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey as seq", "p_name as product", "cast(p_size % 4 as double) as price",
        "concat('http://x/', p_type, '.jpg?v=', p_partkey) as imageUrl",
        "if(p_partkey % 3 = 0, cast(p_partkey as string), '') as klNr", "if(p_partkey % 2 = 0, p_brand, '') as category",
    )
    return dedupe.merge_prefer_key(rows, ["seq"]).drop("imageUrl")


@query("union_sources", """
SELECT 'part' AS source, count(*) AS rows, count(brand) AS brands FROM (SELECT p_brand AS brand FROM part)
UNION ALL SELECT 'supplier', count(*), 0 FROM supplier""")
def union_sources(spark, sf):
    parts = table(spark, sf, "part").selectExpr("'part' as source", "p_name as product", "p_brand as brand")
    stores = table(spark, sf, "supplier").selectExpr("'supplier' as source", "s_name as product")
    both = dedupe.union_sources(parts, stores)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count("brand").alias("brands"))


@query("distinct_by", with_offers('SELECT DISTINCT "storeId", product FROM offers'))
def distinct_by(spark, sf):
    return dedupe.distinct_by(offers_view(spark, sf).select("storeId", "product"), "storeId", "product")


BATCH = "SELECT id, product || ' ' || brand || ' ' || \"storeId\" AS product, price, \"storeId\", confidence FROM offers"
BATCH_SQL = f""", o AS ({BATCH}), base AS (SELECT * FROM o WHERE confidence <> 'low'),
cand AS (SELECT * FROM o WHERE confidence = 'low'),
added AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {t3('product')} ORDER BY id) AS rn FROM cand
 WHERE {t3('product')} NOT IN (SELECT {t3('product')} FROM base)) WHERE rn = 1)"""


def _batch(spark, sf):
    offers = offers_view(spark, sf).select(
        "id", F.concat_ws(" ", "product", "brand", "storeId").alias("product"), "price", "storeId", "confidence"
    )
    return offers.filter("confidence <> 'low'"), offers.filter("confidence = 'low'")


@query("append_new", with_offers(BATCH_SQL + "SELECT id, product FROM base UNION ALL SELECT id, product FROM added"))
def append_new(spark, sf):
    base, candidates = _batch(spark, sf)
    return dedupe.append_new(base, candidates, ["id"]).select("id", "product")


@query("append_report", with_offers(BATCH_SQL + """
SELECT (SELECT count(*) FROM base) AS original, (SELECT count(*) FROM added) AS added,
 (SELECT count(*) FROM cand) - (SELECT count(*) FROM added) AS skipped,
 (SELECT count(*) FROM base) + (SELECT count(*) FROM added) AS output"""))
def append_report(spark, sf):
    base, candidates = _batch(spark, sf)
    return dedupe.append_report(base, candidates, ["id"])


@query("probably_new", with_offers(BATCH_SQL + f"SELECT id FROM cand WHERE {t3('product')} NOT IN (SELECT {t3('product')} FROM base)"))
def probably_new(spark, sf):
    base, candidates = _batch(spark, sf)
    return dedupe.not_present(candidates, base).select("id")


# --- sorts and top-k ---------------------------------------------------------
# The global order is the answer, so it is a column: a comparison of row sets sees no order.
CZECH = "replace(lower({}), 'ch', 'h{{')"


@query("sort_visible", with_offers("""
, v AS (SELECT id, coalesce(nullif("unitPrice", 0), nullif(price, 0), 0) AS value FROM offers)
SELECT id, value, row_number() OVER (ORDER BY value, id) AS rank FROM v"""))
def sort_visible(spark, sf):
    ranked = lines.with_rank(offers_view(spark, sf), *lines.visible_order())
    return ranked.select("id", F.coalesce(lines.comparable_value(), F.lit(0.0)).alias("value"), "rank")


@query("sort_by_store_and_product", with_offers(f"""
SELECT id, "storeName", product, row_number() OVER (ORDER BY {CZECH.format('"storeName"')}, {CZECH.format('product')}, id) AS rank FROM offers"""))
def sort_by_store_and_product(spark, sf):
    return lines.with_rank(offers_view(spark, sf), *lines.store_and_product_order("id")).select("id", "storeName", "product", "rank")


@query("sort_by_page", with_offers(f"""
SELECT id, "pageNumber", product, row_number() OVER (ORDER BY "pageNumber", {CZECH.format('product')}, id) AS rank FROM offers"""))
def sort_by_page(spark, sf):
    return lines.with_rank(offers_view(spark, sf), *lines.page_order("id")).select("id", "pageNumber", "product", "rank")


@query("sort_by_risk", with_offers("""
, c AS (SELECT "storeId", confidence AS risk, count(*) AS missing FROM offers GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, missing DESC, "storeId") AS rank FROM c"""))
def sort_by_risk(spark, sf):
    counts = offers_view(spark, sf).groupBy("storeId", F.col("confidence").alias("risk")).agg(F.count(F.lit(1)).alias("missing"))
    return lines.with_rank(counts, *lines.risk_order("risk", "missing", "storeId"))


@query("chain_ordinals", with_offers("""
SELECT id, chain, row_number() OVER (PARTITION BY chain ORDER BY price, id) AS ordinal,
 CAST(sum(CASE WHEN suspect THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY price, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM offers"""))
def chain_ordinals(spark, sf):
    """W2 and W4 where five keys hold all rows: ordinals and running block ids by chain."""
    numbered = ordered.running_totals(
        offers_view(spark, sf), ["chain"], ["price", "id"], {"ordinal": F.lit(1), "block": F.col("suspect").cast("int")}
    )
    return numbered.select("id", "chain", "ordinal", "block")


@query("top_missing_pages", """
SELECT l_partkey AS page, count(*) AS missing FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def top_missing_pages(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("page")).agg(F.count(F.lit(1)).alias("missing"))
    return lines.top_k(counts, 15, F.desc("missing"), F.asc("page"))


@query("top_k_per_group", with_offers("""
SELECT "pageNumber", id, rank FROM (SELECT "pageNumber", id, row_number() OVER (PARTITION BY "pageNumber" ORDER BY price, id) AS rank
 FROM offers) WHERE rank <= 12"""))
def top_k_per_group(spark, sf):
    top = lines.top_k_per_group(offers_view(spark, sf), ["pageNumber"], 12, F.asc("price"), F.asc("id"))
    return top.select("pageNumber", "id", F.col("rank").cast("bigint").alias("rank"))
