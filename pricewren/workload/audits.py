"""Queries for validation, duplicates, noise, coverage and import audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.functions import quality as Q
from pricewren.operators import enrich
from pricewren.plans import audit, combine
from pricewren.sources import readers
from pricewren.workload.extraction import LEAFLET_SQL, _t, leaflets
from pricewren.workload.registry import query
from pricewren.workload.views import amount_text, compare_key_sql, dealt_parts, offers_view, t2, table, wide_table, with_offers

# --- combine -----------------------------------------------------------------
KEY = compare_key_sql("product", '"packageSize"')
COMBINE_SQL = with_offers(f"""
, s AS (SELECT *, CASE WHEN confidence = 'low' THEN 1 ELSE 0 END AS src FROM offers WHERE NOT suspect AND price IS NOT NULL AND length(product) >= 3)
SELECT id, "storeId", product, price, {KEY} AS "compareKey", CASE src WHEN 0 THEN 'feed one' ELSE 'feed two' END AS "sourceFile" FROM
 (SELECT *, row_number() OVER (PARTITION BY "storeId", {KEY}, "packageSize", price, "unitPrice", "pageNumber" ORDER BY src DESC, id DESC) AS rn FROM s) WHERE rn = 1""")


def _combined(spark, sf, sort=False):
    offers = offers_view(spark, sf)
    sources = {"feed one": offers.filter("confidence <> 'low'"), "feed two": offers.filter("confidence = 'low'")}
    return combine.combine_offers(sources, order=("sourceOrder", "id"), sort=sort)


@query("combine_offers", COMBINE_SQL)
def combine_offers(spark, sf):
    return _combined(spark, sf).select("id", "storeId", "product", "price", "compareKey", "sourceFile")


@query("enrich_offer", with_offers(f"""
SELECT id, product || ' pivo' AS product, 'světlý ležák' AS description, 'pivo' AS category, {compare_key_sql("product || ' pivo'", '"packageSize"')} AS "compareKey"
FROM offers WHERE "packageSize" IN ('11 g', '12 g')
UNION ALL SELECT id, product || ' pivo', CASE WHEN "packageSize" IN ('11 g', '12 g') THEN 'x' WHEN "packageSize" = '10 g' THEN 'světlé výčepní pivo' ELSE 'pivo' END, 'pivo', {compare_key_sql("product || ' pivo'", '"packageSize"')}
FROM offers WHERE "packageSize" NOT IN ('11 g', '12 g')"""))
def enrich_offer(spark, sf):
    offers = offers_view(spark, sf).drop("category")
    brewed = offers.withColumns({
        "product": F.concat("product", F.lit(" pivo")), "rawContext": F.split("packageSize", " ")[0],
    })
    return enrich.enrich_offer(enrich.normalize_offer(brewed, "feed")).select("id", "product", "description", "category", "compareKey")


@query("filter_marketing", LEAFLET_SQL + "SELECT page_id, name AS product FROM rows WHERE amount % 300 <> 0")
def filter_marketing(spark, sf):
    rows = leaflets(spark, sf).select(
        "page_id", F.col("name").alias("product"), F.lit("").alias("description"),
        F.when(F.col("amount") % 300 == 0, F.lit("dnes vezměte si z regálu")).otherwise(F.lit("běžný text")).alias("rawContext"),
    )
    return combine.filter_marketing(rows).select("page_id", "product")


@query("import_reconciliation", with_offers(f"""
, e(label) AS (VALUES ('small ring'), ('red widget'), ('no such product')),
s AS (SELECT id, contains(product, 'red widget') AS gone, {t2("product || ' ' || brand || ' ' || category || ' ' || \"packageSize\" || ' ' || \"storeName\" || ' ' || \"storeId\" || ' ' || chain")} AS t FROM offers),
r AS (SELECT label, (SELECT count(*) FROM s WHERE contains(t, label)) AS a, (SELECT count(*) FROM s WHERE contains(t, label) AND NOT gone) AS b FROM e)
SELECT label, a AS "inSource", b AS "inCombined", CASE WHEN a > 0 AND b = 0 THEN 'lost-in-combine' WHEN a = 0 THEN 'missing-in-source' ELSE 'ok' END AS diagnosis FROM r"""))
def import_reconciliation(spark, sf):
    """The combined side lacks one of the products, so that all three diagnoses occur."""
    offers = offers_view(spark, sf)
    combined = offers.filter(~F.contains("product", F.lit("red widget")))
    return audit.import_reconciliation(offers, combined, ["small ring", "red widget", "no such product"])


@query("coverage_by_file", with_offers(f"""
SELECT category AS "sourceFile", count(*) AS offers, count(*) FILTER (WHERE chain = 'ASIA') AS "chainOffers",
 count(*) FILTER (WHERE contains(product, 'ring') OR contains(product, 'bolt')) AS "termOffers",
 count(*) FILTER (WHERE chain = 'ASIA' AND (contains(product, 'ring') OR contains(product, 'bolt'))) AS "chainTermOffers" FROM offers GROUP BY 1"""))
def coverage_by_file(spark, sf):
    offers = offers_view(spark, sf).withColumnRenamed("category", "sourceFile").select("sourceFile", "product", "chain", "storeName", "storeId")
    return audit.coverage_by_file(offers, "asia", ["Ring", "bölt"])


@query("control_query_report", with_offers(f"""
, q(label, q) AS (VALUES ('rings', 'small ring'), ('asia', 'asia'))
SELECT label, (SELECT count(*) FROM offers WHERE confidence <> 'low' AND (contains(product, q) OR contains(lower(chain), q))) AS current,
 (SELECT count(*) FROM offers WHERE confidence = 'low' AND (contains(product, q) OR contains(lower(chain), q))) AS candidates FROM q"""))
def control_query_report(spark, sf):
    offers = offers_view(spark, sf)
    return audit.control_query_report(offers.filter("confidence <> 'low'"), offers.filter("confidence = 'low'"), [("rings", "Small ring"), ("asia", "ASIA")])


# --- structure ---------------------------------------------------------------
BROKEN_SQL = """, b AS (SELECT id, CASE WHEN "pageNumber" = 3 THEN NULL ELSE price END AS price, CASE WHEN confidence = 'low' THEN '' ELSE product END AS product FROM offers)"""


def _broken(spark, sf):
    return offers_view(spark, sf).withColumns({
        "price": F.when(F.col("pageNumber") != 3, F.col("price")), "product": F.when(F.col("confidence") == "low", F.lit("")).otherwise(F.col("product")),
    })


@query("validate_offers", with_offers(BROKEN_SQL + "SELECT id, 'price' AS field FROM b WHERE price IS NULL UNION ALL SELECT id, 'product' FROM b WHERE product = ''"))
def validate_offers(spark, sf):
    return audit.validate_offers(_broken(spark, sf), "id")


@query("first_violation", with_offers(BROKEN_SQL + """SELECT id, CASE WHEN product = '' THEN 'product' ELSE 'price' END AS field FROM b
 WHERE price IS NULL OR product = '' ORDER BY id LIMIT 1"""))
def first_violation(spark, sf):
    return audit.first_violation(_broken(spark, sf), "id")


@query("profile_fields", """SELECT count(*) AS total, count(*) AS "withProduct", count(*) FILTER (WHERE p_size > 10) AS "withPrice",
 count(*) FILTER (WHERE p_partkey % 3 = 0) AS "withKey" FROM part""")
def profile_fields(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_name as product", "if(p_size > 10, p_retailprice, null) as price", "if(p_partkey % 3 = 0, p_brand, '') as klNr")
    return audit.profile_fields(rows)


@query("schema_profile", """
SELECT '$' AS path, 'OBJECT' AS type, count(*) AS count FROM events UNION ALL SELECT 'props', 'OBJECT', count(*) FROM events
UNION ALL SELECT p, 'OBJECT', count(*) FROM events, (VALUES ('a'), ('a.b'), ('a.b.c'), ('a.b.c.d'), ('a.b.c.d.e'), ('a.b.c.d.e.f')) t(p) GROUP BY p
UNION ALL SELECT 'a.b.c.d.e.f.g', 'STRING', count(*) FROM events
UNION ALL SELECT 'props.k', 'BIGINT', count(*) FROM events UNION ALL SELECT 'kinds', 'ARRAY', count(*) FROM events
UNION ALL SELECT 'kinds[]', 'STRING', 2 * count(*) FROM events""")
def schema_profile(spark, sf):
    doc = F.concat(F.lit('{"props": '), "props", F.lit(', "kinds": ["'), "event_type", F.lit('", "x"], "a":{"b":{"c":{"d":{"e":{"f":{"g":"[{\\\\"}}}}}}}'))
    events = table(spark, sf, "events").select(doc.alias("doc"))
    return audit.schema_profile(events, "doc").select("path", "type", "count")


@query("object_keys", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS t FROM events)
SELECT '$' AS path, k AS key, n AS count FROM n, (VALUES ('props'), ('list')) v(k) UNION ALL SELECT '$', 'extra', t FROM n
UNION ALL SELECT 'props', 'k', n FROM n UNION ALL SELECT 'list[]', 'a', 2 * n FROM n UNION ALL SELECT 'list[]', 'b', n FROM n
UNION ALL SELECT 'list[].a', 'c', n FROM n UNION ALL SELECT 'extra', 'deep', t FROM n""")
def object_keys(spark, sf):
    """Keys of the objects at every path, some of which only a third of the items have."""
    extra = F.when(F.col("event_id") % 3 == 0, F.lit(', "extra": {"deep": null}')).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"props": '), "props", F.lit(', "list": [{"a": {"c": 1}}, {"a": 2, "b": []}, 7]'), extra, F.lit("}"))
    return audit.object_keys(table(spark, sf, "events").select(doc.alias("doc")), "doc")


# --- duplicates and noise ----------------------------------------------------
@query("exact_duplicate_groups", """
SELECT p_size AS page, p_name AS name, CAST(p_size % 5 AS DOUBLE) AS price, count(*) AS count FROM part GROUP BY ALL HAVING count(*) > 1""")
def exact_duplicate_groups(spark, sf):
    return audit.exact_duplicate_groups(_part_offers(spark, sf))


def _part_offers(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey as id", "p_size as pageNumber", "p_name as product", "cast(p_size % 5 as double) as price", "p_type as category"
    )


@query("duplicate_items", """
SELECT id, count FROM (SELECT p_partkey AS id, count(*) OVER (PARTITION BY p_size, p_name) AS count FROM part) WHERE count > 1""")
def duplicate_items(spark, sf):
    return audit.duplicate_items(_part_offers(spark, sf)).select("id", "count")


@query("near_duplicate_groups", """
SELECT p_size AS page, p_name AS name, count(*) AS count FROM part GROUP BY ALL HAVING count(*) > 1""")
def near_duplicate_groups(spark, sf):
    return audit.near_duplicate_groups(_described_offers(spark, sf))


def _described_offers(spark, sf):
    word = F.element_at(F.array(F.lit("Světlý "), F.lit("různé druhy "), F.lit("")), (F.col("id") % 3 + 1).cast("int"))
    return _part_offers(spark, sf).withColumn("product", F.concat(word, F.col("product")))


@query("near_duplicate_items", """
SELECT p_partkey AS id, count(*) OVER (PARTITION BY p_size, p_name) AS count FROM part QUALIFY count > 1""")
def near_duplicate_items(spark, sf):
    return audit.near_duplicate_items(_described_offers(spark, sf)).select("id", "count")


@query("similar_name_groups", """
WITH RECURSIVE o AS (SELECT p_partkey AS id, p_size AS page, list_sort(list_distinct(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')), ' '))) AS ws FROM part),
c AS (SELECT page, ws, min(id) AS id FROM o GROUP BY ALL),
l AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.page = b.page AND a.id <> b.id
 AND 100 * len(list_intersect(a.ws, b.ws)) >= 60 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))),
r AS (SELECT id, id AS other FROM c UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
g AS (SELECT id, min(other) AS "groupId" FROM r GROUP BY id)
SELECT o.id, g."groupId" FROM o JOIN c ON o.page = c.page AND o.ws = c.ws JOIN g ON g.id = c.id""")
def similar_name_groups(spark, sf):
    offers = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("pageNumber"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("product")
    )
    return audit.similar_name_groups(offers).select("id", "groupId")


NOISY_SQL = """
WITH o AS (SELECT p_partkey AS id, p_size AS page, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'záloha na lahev ' || p_name WHEN 2 THEN 'a 12,90 ' || p_name
 ELSE p_name || ' < 9,90 Kč' END AS product, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_type END AS category FROM part)"""


def _noisy(spark, sf):
    name = F.col("p_name")
    product = (
        F.when(F.col("p_partkey") % 4 == 0, name).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("záloha na lahev "), name))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("a 12,90 "), name)).otherwise(F.concat(name, F.lit(" < 9,90 Kč")))
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("pageNumber"), product.alias("product"), F.col("p_retailprice").alias("price"),
        F.lit("").alias("priceText"), F.when(F.col("p_partkey") % 8 == 0, F.lit("")).otherwise(F.col("p_type")).alias("category"),
    )


@query("noise_audit", NOISY_SQL + """
SELECT id, recommendation FROM (SELECT id, CASE WHEN product LIKE 'záloha%' OR product LIKE 'a 12%' THEN 'candidate-remove-or-replace-with-clean-existing'
 WHEN page IN (20, 23, 35) THEN 'candidate-fix-fields' WHEN product LIKE '%9,90 Kč' THEN 'manual-review' END AS recommendation FROM o) WHERE recommendation IS NOT NULL""")
def noise_audit(spark, sf):
    return audit.noise_audit(_noisy(spark, sf)).select("id", "recommendation")


@query("noise_totals", NOISY_SQL + """
SELECT 'deposit-in-product-name' AS id, 'high' AS severity, count(*) AS offers FROM o WHERE product LIKE 'záloha%'
UNION ALL SELECT 'starts-with-price-fragment', 'high', count(*) FROM o WHERE product LIKE 'a 12%'
UNION ALL SELECT 'product-contains-price-marker', 'medium', count(*) FROM o WHERE product LIKE '%9,90 Kč'
UNION ALL SELECT 'empty-price-text-with-known-imported-page', 'low', count(*) FROM o WHERE page IN (20, 23, 35)
UNION ALL SELECT 'missing-category', 'low', count(*) FROM o WHERE page IN (20, 23, 35) AND category = ''""")
def noise_totals(spark, sf):
    return audit.noise_totals(audit.noise_audit(_noisy(spark, sf)))


@query("max_severity", NOISY_SQL + """
SELECT id, CASE WHEN product LIKE 'záloha%' OR product LIKE 'a 12%' THEN 3 WHEN product LIKE '%9,90 Kč' THEN 2 ELSE 1 END AS severity FROM o
WHERE NOT (id % 4 = 0 AND page NOT IN (20, 23, 35))""")
def max_severity(spark, sf):
    return audit.noise_audit(_noisy(spark, sf)).select("id", Q.max_severity(F.col("findings")).alias("severity"))


# --- candidates --------------------------------------------------------------
def _candidates(spark, sf):
    rows = leaflets(spark, sf)
    return rows.select(
        "page_id", F.col("page_number").alias("pageNumber"), F.concat("name", F.lit(" "), "p_brand").alias("product"), _t("@amount", " g").alias("packageSize"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("pivo")).otherwise(F.lit("")).alias("category"),
        F.when(F.col("amount") % 400 == 0, F.lit("osoba/nákup/ den")).otherwise(F.lit("čistý text")).alias("rawContext"),
        F.when(F.col("amount") % 200 == 0, F.lit("high")).otherwise(F.lit("medium")).alias("confidence"),
        (F.col("pack_cents") / 100).alias("price"), amount_text(F.col("pack_cents")).alias("priceText"),
    )


@query("bucket_candidates", LEAFLET_SQL + """
SELECT page_id, CASE WHEN amount % 400 = 0 THEN 'review' WHEN p_type = 'ECONOMY' THEN 'safe' ELSE 'review' END AS bucket FROM rows""")
def bucket_candidates(spark, sf):
    c = _candidates(spark, sf)
    bucket = Q.bucket_candidate(F.col("product"), F.col("packageSize"), F.col("category"), F.lit("generic-hidden-html"), F.col("rawContext"), F.lit(False), F.lit(False))
    return c.select("page_id", bucket["bucket"].alias("bucket"))


@query("strict_filter", LEAFLET_SQL + """
SELECT page_id, CASE WHEN amount % 200 <> 0 THEN 1 ELSE 0 END + CASE WHEN pack_cents % 100 NOT IN (0, 90, 99) THEN 2 ELSE 0 END
 + CASE WHEN len(list_filter(string_split(lower(name || ' ' || replace(p_brand, '#', ' ')), ' '), lambda w: length(w) >= 4)) < 2 THEN 1 ELSE 0 END AS reasons FROM rows""")
def strict_filter(spark, sf):
    c = _candidates(spark, sf)
    found = Q.strict_reasons(F.col("confidence"), F.col("price"), F.col("priceText"), F.col("packageSize"), F.col("product"), F.col("category"), F.lit("text"))
    return c.select("page_id", F.size(found).alias("reasons"))


@query("category_mismatch", LEAFLET_SQL + """
SELECT page_id, p_type = 'ECONOMY' AND amount % 200 = 0 AS mismatch, amount = 500 AND p_type = 'SMALL' AS package_mismatch FROM rows""")
def category_mismatch(spark, sf):
    rows = leaflets(spark, sf)
    product = F.concat("name", F.when(F.col("amount") % 200 == 0, F.lit(" káva")).otherwise(F.lit("")))
    category = F.when(F.col("p_type") == "ECONOMY", F.lit("ovoce zelenina")).otherwise(F.lit("jiné"))
    sweet = F.concat("name", F.when(F.col("p_type") == "SMALL", F.lit(" SUŠENKY")).otherwise(F.lit("")))
    return rows.select(
        "page_id", Q.category_mismatch(category, product, F.lit("")).alias("mismatch"),
        Q.package_mismatch(sweet, _t("@amount", " g")).alias("package_mismatch"),
    )


@query("score_candidate", LEAFLET_SQL + """
SELECT page_id, CASE WHEN p_type = 'ECONOMY' THEN 3 ELSE 0 END + 2 + 2 + CASE WHEN length(name || ' ' || p_brand) BETWEEN 8 AND 70 THEN 2 ELSE 0 END
 - CASE WHEN amount % 400 = 0 THEN 2 ELSE 0 END AS score FROM rows""")
def score_candidate(spark, sf):
    c = _candidates(spark, sf)
    return c.select("page_id", Q.score_candidate(F.col("category"), F.col("packageSize"), F.lit("action-lt"), F.col("product"), F.col("rawContext")).alias("score"))


@query("score_import", LEAFLET_SQL + """
SELECT page_id, CASE WHEN page_number = 1 THEN 100 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 10 ELSE 0 END + 5 + 3.0::DOUBLE AS score FROM rows""")
def score_import(spark, sf):
    c = _candidates(spark, sf)
    return c.select("page_id", Q.score_import(F.col("pageNumber") == 1, F.col("category"), F.col("packageSize"), F.col("price"), F.col("product")).alias("score"))


@query("confidence_by_reasons", LEAFLET_SQL + """
SELECT page_id, CASE WHEN n >= 2 THEN 'review' WHEN n = 1 THEN 'medium' ELSE 'high' END AS confidence FROM
 (SELECT page_id, (amount % 200 = 0)::INT + (page_number = 1)::INT AS n FROM rows)""")
def confidence_by_reasons(spark, sf):
    found = Q.reasons((F.col("amount") % 200 == 0, "a"), (F.col("page_number") == 1, "b"))
    return leaflets(spark, sf).select("page_id", Q.confidence_by_reasons(found, F.lit(1.0)).alias("confidence"))


@query("terms_for_category", LEAFLET_SQL + """
SELECT page_id, CASE WHEN p_type = 'ECONOMY' THEN 'pivo|světlé pivo|ležák|výčepní pivo|radler|míchaný nápoj' ELSE p_type || '|radler|míchaný nápoj' END AS terms FROM rows""")
def terms_for_category(spark, sf):
    category = F.when(F.col("p_type") == "ECONOMY", F.lit("pivo")).otherwise(F.col("p_type"))
    terms = enrich.terms_for_category(F.concat("name", F.lit(" COOL")), category)
    return leaflets(spark, sf).select("page_id", F.array_join(terms, "|").alias("terms"))


@query("page_bucket_counts", with_offers("""
SELECT "pageNumber", count(*) AS total, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium,
 count(*) FILTER (WHERE confidence = 'low') AS low FROM offers GROUP BY 1"""))
def page_bucket_counts(spark, sf):
    return audit.page_bucket_counts(offers_view(spark, sf), "pageNumber", "confidence", ["high", "medium", "low"])


@query("page_samples", with_offers("""
SELECT "pageNumber", id FROM (SELECT "pageNumber", id, row_number() OVER (PARTITION BY "pageNumber" ORDER BY id) AS rn FROM offers) WHERE rn <= 20"""))
def page_samples(spark, sf):
    return audit.page_samples(offers_view(spark, sf), "pageNumber", "id").select("pageNumber", "id")


# --- page audits -------------------------------------------------------------
def _marker_pages(spark, sf):
    """One page per part: as many rough price markers as its size says."""
    n = F.col("p_size") % 12
    price = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat((i + 10).cast("string"), F.lit(",90 "), (i + 20).cast("string"), F.lit(",90/ 25%")))
    text = F.concat_ws(" ", F.array_join(price, " "), F.lit("nabídka Jedinečná 5,90 nabídka Jedinečná 5,90 Super Cena! 7,90\nKÁVA ALFA\n12,90\n"), "p_name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pageNumber"), text.alias("text"))


@query("rough_markers", """
SELECT p_partkey AS page, CAST(p_size % 12 + 1 AS INTEGER) AS pairs, 1 AS banners, CAST(p_size % 12 + 3 AS INTEGER) AS total FROM part""")
def rough_markers(spark, sf):
    pages = _marker_pages(spark, sf).withColumn("m", audit.rough_markers("text"))
    return pages.select(F.col("pageNumber").alias("page"), "m.pairs", F.col("m.unique").alias("banners"), "m.total")


@query("page_gap_audit", """
WITH p AS (SELECT p_partkey AS page, p_size FROM part UNION ALL SELECT -1 - p_partkey, p_size FROM part),
c AS (SELECT l_partkey AS page, count(*) AS n FROM lineitem GROUP BY 1)
SELECT page AS "pageNumber", CAST(p_size % 12 + 3 AS INTEGER) AS markers, coalesce(n, 0) AS offers, greatest(p_size % 12 + 3 - coalesce(n, 0), 0) AS "gapScore"
FROM p LEFT JOIN c USING (page) WHERE greatest(p_size % 12 + 3 - coalesce(n, 0), 0) >= 5 OR coalesce(n, 0) = 0""")
def page_gap_audit(spark, sf):
    """All pages against all offers, and once more under numbers that no offer has."""
    pages = _marker_pages(spark, sf)
    pages = pages.unionByName(pages.withColumn("pageNumber", -1 - F.col("pageNumber")))
    offers = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pageNumber"))
    return audit.page_gap_audit(pages, offers).select("pageNumber", "markers", "offers", "gapScore")


def _coverage_pages(spark, sf):
    filler = " " + "x" * 300 + " "
    name = F.concat(F.upper("p_name"), F.lit(" NR"), F.col("p_partkey").cast("string"), F.lit("X"))
    text = F.concat(F.lit("strana 50% "), name, F.lit(" 100 g < 12,90 Kč" + filler + "30% "), name, F.lit(" PIVO 200 g < 15,90 Kč" + filler + "konec"))
    return dealt_parts(spark, sf).select(F.col("p_partkey").alias("pageNumber"), text.alias("text"))


@query("coverage_audit", """
WITH p AS (SELECT p_partkey AS page, true AS known FROM part UNION ALL SELECT -1 - p_partkey, false FROM part)
SELECT page AS "pageNumber", 2 AS "actionMarkers", CASE WHEN known THEN 1 ELSE 0 END AS offers, 2 AS candidates, 2 AS useful,
 CASE WHEN known THEN 0 ELSE 2 END AS missing FROM p""")
def coverage_audit(spark, sf):
    """Every page twice: with its offer, and under a number without offers, its names changed."""
    offers = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pageNumber"), F.lit("").alias("category"),
        F.concat("p_name", F.lit(" nr"), F.col("p_partkey").cast("string"), F.lit("x pivo")).alias("product"),
    )
    pages = _coverage_pages(spark, sf)
    absent = pages.select((-1 - F.col("pageNumber")).alias("pageNumber"), F.regexp_replace("text", r" NR(\d+)X", " NEW$1Q").alias("text"))
    return _coverage_numbers(audit.coverage_audit(pages.unionByName(absent), offers))


def _coverage_numbers(df):
    ints = [F.col(c).cast("int").alias(c) for c in ("actionMarkers", "offers", "candidates", "useful", "missing")]
    return df.select("pageNumber", *ints)


@query("coverage_risk", """
SELECT p_size % 12 AS markers, p_size % 5 AS offers, CASE WHEN p_size % 12 = 0 THEN 'none' WHEN p_size % 7 >= 8 OR p_size % 12 >= p_size % 5 + 10 THEN 'high'
 WHEN p_size % 7 >= 4 OR p_size % 12 >= p_size % 5 + 5 THEN 'medium' WHEN p_size % 7 >= 1 THEN 'low' ELSE 'none' END AS risk, count(*) AS pages FROM part GROUP BY ALL""")
def coverage_risk(spark, sf):
    size = F.col("p_size")
    risk = audit.coverage_risk(size % 12, size % 5, size % 7, F.lit(0), F.lit(False))
    return table(spark, sf, "part").groupBy((size % 12).alias("markers"), (size % 5).alias("offers"), risk.alias("risk")).agg(F.count(F.lit(1)).alias("pages"))


@query("extraction_stats", """
SELECT p.page_id, CAST(length(html) AS INTEGER) AS "textLength", coalesce(n, 0) AS offers, coalesce(c, 0) AS clean, coalesce(n - c, 0) AS suspect FROM pages p LEFT JOIN
 (SELECT CAST(l_partkey % 400 AS BIGINT) AS page_id, count(*) AS n, count(*) FILTER (WHERE NOT (l_linestatus = 'O' AND l_returnflag = 'R')) AS c FROM lineitem GROUP BY 1) USING (page_id)""")
def extraction_stats(spark, sf):
    offers = table(spark, sf, "lineitem").select((F.col("l_partkey") % 400).alias("page_id"), ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).alias("suspect"))
    return audit.extraction_stats(table(spark, sf, "pages"), offers, "html")


@query("image_coverage", """
WITH c AS (SELECT l_partkey AS page, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS pages, count(*) FILTER (WHERE p_size > 25) AS "pagesWithImage", CAST(sum(coalesce(n, 0)) AS BIGINT) AS offers,
 CAST(coalesce(sum(n) FILTER (WHERE p_size > 25), 0) AS BIGINT) AS "coveredOffers" FROM part LEFT JOIN c ON page = p_partkey""")
def image_coverage(spark, sf):
    pages = table(spark, sf, "part").selectExpr("p_partkey as pageNumber", "if(p_size > 25, p_name, '') as pageImageUrl")
    return audit.image_coverage(pages, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pageNumber")))


@query("index_coverage", """
SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS "indexKeys", (SELECT count(*) FROM part WHERE p_partkey % 3 <> 0) AS "usedKeys",
 (SELECT count(*) FROM part WHERE p_partkey % 3 <> 0 AND p_partkey IN (SELECT o_custkey FROM orders)) AS "matchedKeys",
 (SELECT count(*) FROM part) AS offers, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0) AS "offersWithoutKey" """)
def index_coverage(spark, sf):
    offers = table(spark, sf, "part").selectExpr("if(p_partkey % 3 = 0, '', cast(p_partkey as string)) as klNr")
    index = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("klNr"))
    return audit.index_coverage(offers, index)


# --- checks ------------------------------------------------------------------
@query("target_checks", """
SELECT * FROM (VALUES ('ring', 'small ring', 3, 'ok'), ('widget', 'red widget', 5, 'price-mismatch'), ('none', 'no such thing', 1, 'missing-in-pdf-text'),
 ('word', 'strana', 1, 'missing-in-current-offers')) t(label, query, "expectedPage", status) WHERE (SELECT count(*) FROM lineitem) > 0""")
def target_checks(spark, sf):
    offers = offers_view(spark, sf)
    pages = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("pageNumber"), F.concat(F.lit("strana "), F.upper("p_name")).alias("text"))
    checks = [("ring", "Small RING", 3, None), ("widget", "red widget", 5, 0.01), ("none", "no such thing", 1, None), ("word", "Strana", 1, None)]
    found = audit.target_checks(pages, offers, checks)
    return found.select("label", F.lower("query").alias("query"), "expectedPage", "status")


@query("target_gaps", """
SELECT * FROM (VALUES ('known', 1, 'already-in-current-offers'), ('priced', 2, 'targeted-candidate-with-price'), ('unpriced', 3, 'targeted-candidate-needs-price-review'),
 ('absent', 4, 'target-not-found')) t(label, "expectedPage", status) WHERE (SELECT count(*) FROM part) > 0""")
def target_gaps(spark, sf):
    size = F.col("p_partkey").cast("int")
    text = F.concat(F.upper("p_name"), F.when(size == 3, F.lit(" ZBOŽÍ nebo PRVNÍ bez ceny")).otherwise(F.lit(" ZBOŽÍ je PRVNÍ < 5,90 Kč 12,90 konec")))
    pages = table(spark, sf, "part").select(size.alias("pageNumber"), text.alias("text"))
    offers = table(spark, sf, "part").select(size.alias("pageNumber"), F.col("p_name").alias("product"), F.when(size == 1, F.lit("zboží první")).otherwise(F.lit("x")).alias("category"))
    targets = [("known", 1, ["zboží první"]), ("priced", 2, ["něco jiného", "zboží první"]), ("unpriced", 3, ["ZBOŽÍ PRVNÍ"]), ("absent", 4, ["úplně jinde"])]
    return audit.target_gaps(pages, offers, targets).select("label", "expectedPage", "status")


@query("query_report", with_offers("""
, c(label, q, m) AS (VALUES ('rings', 'small ring', 10), ('nothing', 'no such', 1), ('asia', 'asia', 1000000000))
SELECT label, n AS matches, m AS minimum, n < m AS problem FROM (SELECT label, m, (SELECT count(*) FROM offers WHERE contains(product, q) OR contains(lower(chain), q)) AS n FROM c)"""))
def query_report(spark, sf):
    return audit.query_report(offers_view(spark, sf), [("rings", "small RING", 10), ("nothing", "no such", 1), ("asia", "Asia", 1_000_000_000)])


@query("search_mode_comparison", with_offers("""
, q(query, k) AS (VALUES ('Small Ring', 'small ring'), ('Asia', 'asia'), ('zzz', 'zzz'))
SELECT query, f AS "full", p AS "productDescription", p AS "productOnly", CASE WHEN f > 0 AND p = 0 THEN 'full-search-finds-results-but-product-only-does-not' ELSE 'ok' END AS diagnosis
FROM (SELECT query, (SELECT count(*) FROM offers WHERE contains(product, k) OR contains(lower(chain), k)) AS f, (SELECT count(*) FROM offers WHERE contains(product, k)) AS p FROM q)"""))
def search_mode_comparison(spark, sf):
    return audit.search_mode_comparison(offers_view(spark, sf), ["Small Ring", "Asia", "zzz"])


# --- page sources ------------------------------------------------------------
@query("source_potential", """
SELECT page_id, CAST(0 AS INTEGER) AS "pdfLinks", false AS "hasNextData", CAST(len(list_distinct(regexp_extract_all(html,
 '(?i)["'']([^"'']*(?:api|graphql|product|products|offers|leaflet|catalog|brochure)[^"'']*)["'']', 1))) AS INTEGER) AS endpoints FROM pages""")
def source_potential(spark, sf):
    return audit.source_potential(wide_table(spark, sf, "pages")).select("page_id", "pdfLinks", "hasNextData", "endpoints")


@query("source_rating", """
SELECT rating, count(*) AS pages FROM (SELECT CASE WHEN contains(html, '__NEXT_DATA__') OR len(list_distinct(regexp_extract_all(html,
 '(?i)["'']([^"'']*(?:api|graphql|product|products|offers|leaflet|catalog|brochure)[^"'']*)["'']', 1))) > 5 THEN 'high-for-structured-data'
 ELSE 'low-or-needs-manual-investigation' END AS rating FROM pages) GROUP BY 1""")
def source_rating(spark, sf):
    return audit.source_potential(wide_table(spark, sf, "pages")).groupBy("rating").agg(F.count(F.lit(1)).alias("pages"))


@query("hidden_vs_visible", """
SELECT p_partkey AS id, 0 AS "visiblePrices", CAST(p_size % 9 + 1 AS INTEGER) AS "hiddenPrices", p_size % 9 + 1 >= 4 AS useful FROM part""")
def hidden_vs_visible(spark, sf):
    prices = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 9), lambda i: F.concat((i + 10).cast("string"), F.lit(",90"))), " ")
    html = F.concat(F.lit('<html><meta name="d" content="zboží '), prices, F.lit(' konec textu"><p>jen text</p></html>'))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), html.alias("html"))
    return audit.hidden_vs_visible(pages, ["zboží"], page="id").select("id", "visiblePrices", "hiddenPrices", "useful")


@query("nearest_image", """
SELECT p_partkey AS id, 'https://shop.example/i/' || n::VARCHAR || '.jpg' AS image FROM part, (SELECT unnest([1, 2]) AS n)""")
def nearest_image(spark, sf):
    key = F.col("p_partkey").cast("string")
    html = F.concat(F.lit("<p>" + "x" * 80 + '</p><img src="/i/3.jpg"><p>'), F.lit("y" * 200), F.lit('</p><img class="a" src="/i/2.jpg"><p>'), "p_name",
                    F.lit(' zboží </p><img data-src="/i/1.jpg"><b>'), key, F.lit("</b>"))
    pages = dealt_parts(spark, sf).select(F.col("p_partkey").alias("page_id"), F.lit("https://shop.example/p.html").alias("url"), html.alias("html"))
    offers = dealt_parts(spark, sf).select(F.col("p_partkey").alias("page_id"), F.concat("p_name", F.lit(" zboží")).alias("product"))
    return audit.nearest_images(pages, offers).select(F.col("page_id").alias("id"), F.col("imageUrl").alias("image"))


# --- sources -----------------------------------------------------------------
def _containers(spark, sf):
    """One JSON container per part, its shape cycling through the accepted ones."""
    offer = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("product"), F.col("p_retailprice").cast("string").alias("price"))
    second = F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit("b")).alias("id"), F.col("p_brand").alias("product"), F.lit("1.5").alias("price"))
    rows = F.array(offer, second)
    shape = F.col("p_partkey") % 4
    doc = (
        F.when(shape == 0, F.to_json(F.struct(rows.alias("offers")))).when(shape == 1, F.to_json(F.struct(rows.alias("items"))))
        .when(shape == 2, F.to_json(F.struct(rows.alias("data")))).otherwise(F.to_json(F.struct(rows.alias("products"))))
    )
    return table(spark, sf, "part").select("p_partkey", doc.alias("doc"), F.to_json(rows).alias("bare"), F.to_json(F.struct(rows.alias("a"), F.array(offer).alias("b"))).alias("nested"))


@query("read_offers", """
SELECT p_partkey, 0 AS seq, p_partkey::VARCHAR AS id, p_name AS product, p_retailprice AS price FROM part
UNION ALL SELECT p_partkey, 1, p_partkey::VARCHAR || 'b', p_brand, 1.5 FROM part""")
def read_offers(spark, sf):
    rows = readers.offers_from_json(_containers(spark, sf), "doc", keep=("p_partkey",))
    return rows.select("p_partkey", "seq", "id", "product", F.col("price").cast("double").alias("price"))


@query("flatten_json_index", """
SELECT p_partkey, 'object' AS shape, 3 AS items, p_name AS first_product FROM part UNION ALL SELECT p_partkey, 'array', 2, p_name FROM part""")
def flatten_json_index(spark, sf):
    docs = _containers(spark, sf)
    both = docs.select("p_partkey", F.explode(F.array(
        F.struct(F.lit("object").alias("shape"), F.col("nested").alias("json")), F.struct(F.lit("array").alias("shape"), F.col("bare").alias("json"))
    )).alias("d")).select("p_partkey", "d.*")
    items = readers.flatten_json_index(both, "json", keep=("p_partkey", "shape"))
    return items.groupBy("p_partkey", "shape").agg(
        F.count(F.lit(1)).cast("int").alias("items"), F.min_by(F.get_json_object("item", "$.product"), "seq").alias("first_product")
    )


@query("load_report", """
SELECT r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS count, false AS missing FROM region
UNION ALL SELECT r_name || ' (not there)', 0, true FROM region""")
def load_report(spark, sf):
    """The nations of all regions, and as many sources that have no row."""
    regions = table(spark, sf, "region")
    rows = table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("sourceFile"))
    names = regions.select(F.explode(F.array(F.col("r_name"), F.concat("r_name", F.lit(" (not there)")))).alias("name"))
    return readers.load_report(rows, names)


@query("read_pdf_pages", """
SELECT CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS INTEGER) WHEN 1 THEN CAST(p_size AS INTEGER) ELSE 7 END AS "pageNumber", p_name AS text FROM part WHERE p_partkey % 5 <> 0""")
def read_pdf_pages(spark, sf):
    items = table(spark, sf, "part").selectExpr(
        "if(p_partkey % 3 = 0, cast(p_partkey as string), null) as pageNumber", "if(p_partkey % 3 = 1, cast(p_size as string), null) as page",
        "cast(null as string) as number", "cast(null as string) as text", "if(p_partkey % 5 = 0, '  ', p_name) as content",
        "cast(null as string) as rawText", "cast(null as string) as pageText",
    )
    return readers.pages_from_items(items, F.lit(7))


@query("scan_files", """
SELECT 'orders.parquet' AS file, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem.parquet', count(*) FROM lineitem""")
def scan_files(spark, sf):
    """Rows per input file, from the scan's file metadata."""
    tagged = [table(spark, sf, n).select(F.col("_metadata.file_name").alias("file")) for n in ("orders", "lineitem")]
    return tagged[0].union(tagged[1]).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


@query("read_html_pages", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS size FROM pages")
def read_html_pages(spark, sf):
    return readers.read_html_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("size"))


@query("write_public", with_offers('SELECT id, product FROM offers'))
def write_public(spark, sf):
    from pricewren.sources.writers import public_columns

    return public_columns(offers_view(spark, sf).withColumn("debug", F.struct("price", "unitPrice"))).select("id", "product")
