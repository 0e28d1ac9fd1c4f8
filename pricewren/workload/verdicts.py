"""Queries for the verdicts of the audits; every branch of a verdict occurs in the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.plans import audit, verdicts
from pricewren.workload.audits import KEY, NOISY_SQL, _noisy
from pricewren.workload.registry import query
from pricewren.workload.views import offers_view, t2, table, with_offers

WATCHED = "(20, 23, 35)"


@query("noise_summary", NOISY_SQL + f"""
, g AS (SELECT *, (id % 4) * 2 + CASE WHEN page IN {WATCHED} THEN 1 ELSE 0 END AS part FROM o),
f AS (SELECT part, product LIKE 'záloha%' OR product LIKE 'a 12%' AS remove, page IN {WATCHED} AS fix, product LIKE '%9,90 Kč' AS marked, product, page, id FROM g)
SELECT part, count(*) AS "totalOffers", count(*) FILTER (WHERE remove OR fix OR marked) AS "noisyOffers", count(*) FILTER (WHERE remove) AS "highRiskOffers",
 count(*) FILTER (WHERE remove) AS "removeCandidates", count(*) FILTER (WHERE fix AND NOT remove) AS "fixFieldCandidates",
 CASE WHEN bool_or(remove) THEN 'inspect-remove-candidates-then-build-cleanup-patch' WHEN bool_or(fix) THEN 'build-field-fix-patch' ELSE 'no-critical-noise-found' END AS "recommendedPath"
FROM f GROUP BY part""")
def noise_summary(spark, sf):
    part = (F.col("id") % 4) * 2 + F.col("pageNumber").isin(20, 23, 35).cast("int")
    found = verdicts.noise_summary(_noisy(spark, sf).withColumn("part", part), ["part"])
    return found.drop("exactDuplicateGroups", "nearDuplicateGroups")


@query("noise_duplicates", """
WITH o AS (SELECT p_brand AS brand, p_size AS page, p_name AS name, CAST(p_size % 5 AS DOUBLE) AS price FROM part),
e AS (SELECT brand, count(*) AS n FROM (SELECT brand FROM o GROUP BY brand, page, name, price HAVING count(*) > 1) GROUP BY 1),
d AS (SELECT brand, count(*) AS n FROM (SELECT brand FROM o GROUP BY brand, page, name HAVING count(*) > 1) GROUP BY 1)
SELECT o.brand, count(*) AS "totalOffers", coalesce(any_value(e.n), 0) AS "exactDuplicateGroups", coalesce(any_value(d.n), 0) AS "nearDuplicateGroups"
FROM o LEFT JOIN e ON e.brand = o.brand LEFT JOIN d ON d.brand = o.brand GROUP BY o.brand""")
def noise_duplicates(spark, sf):
    offers = table(spark, sf, "part").selectExpr(
        "p_partkey as id", "p_brand as brand", "p_size as pageNumber", "p_name as product", "cast(p_size % 5 as double) as price", "p_type as category"
    )
    return verdicts.noise_summary(offers, ["brand"]).select("brand", "totalOffers", "exactDuplicateGroups", "nearDuplicateGroups")


@query("page_minimums", """
WITH w(page, minimum) AS (VALUES (1, 1), (2, 1000000000), (7, 5), (99, 1), (100, 0))
SELECT CAST(page AS BIGINT) AS page, CAST(minimum AS BIGINT) AS minimum, coalesce(n, 0) AS offers, coalesce(n, 0) < minimum AS problem
FROM w LEFT JOIN (SELECT l_linenumber AS p, count(*) AS n FROM lineitem GROUP BY 1) ON p = page""")
def page_minimums(spark, sf):
    return verdicts.page_minimums(offers_view(spark, sf), [(1, 1), (2, 1_000_000_000), (7, 5), (99, 1), (100, 0)])


@query("query_samples", with_offers("""
, c(label, q) AS (VALUES ('rings', 'small ring'), ('asia', 'asia'), ('absent', 'no such product'))
SELECT label, id, rank FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY price, id) AS rank FROM offers
 JOIN c ON contains(product, q) OR contains(lower(chain), q)) WHERE rank <= 20"""))
def query_samples(spark, sf):
    checks = [("rings", "small ring"), ("asia", "Asia"), ("absent", "no such product")]
    found = verdicts.query_samples(offers_view(spark, sf), checks, F.asc("price"), F.asc("id"))
    return found.select("label", "id", F.col("rank").cast("bigint").alias("rank"))


@query("search_verdicts", with_offers("""
, s AS (SELECT * FROM offers WHERE chain = 'ASIA'),
q(query) AS (VALUES ('ring'), ('economy'), ('small'), ('no such product')),
n AS (SELECT query, (SELECT count(*) FROM s WHERE contains(product, query) OR contains(lower(category), query)) AS full_, (SELECT count(*) FROM s WHERE contains(product, query)) AS own FROM q)
SELECT query, 'full-search-finds-results-but-product-only-does-not' AS problem FROM n WHERE full_ > 0 AND own = 0
UNION ALL SELECT query, 'economy-only-in-metadata' FROM n WHERE full_ > 0 AND own = 0 AND query = 'economy'
UNION ALL SELECT 'ring/economy', 'data-search-ok' WHERE (SELECT count(*) FROM n WHERE full_ > 0 AND query IN ('ring', 'economy')) = 2"""))
def search_verdicts(spark, sf):
    compared = audit.search_mode_comparison(offers_view(spark, sf), ["ring", "economy", "small", "no such product"], chain="asia")
    return verdicts.search_verdicts(compared, main="economy", pair=("ring", "economy"))


IMPORT_SQL = """
, src AS (SELECT chain, product, category, 0 AS side FROM offers WHERE NOT (chain = 'EUROPE' AND (contains(product, 'ring') OR category = 'SMALL'))),
com AS (SELECT chain, product, category FROM offers WHERE chain <> 'ASIA' AND NOT (chain = 'AFRICA' AND contains(product, 'gear')) AND NOT (chain = 'AMERICA' AND contains(product, 'gear') AND contains(product || ' ' || lower(category), 'small')))"""


@query("import_problems", with_offers(IMPORT_SQL + """
, s AS (SELECT chain, count(*) FILTER (WHERE contains(product || ' ' || lower(category), 'small')) AS t, count(*) FILTER (WHERE contains(product, 'gear')) AS p FROM
 (SELECT chain, product, category FROM offers WHERE NOT (chain = 'EUROPE' AND contains(product || ' ' || lower(category), 'small'))) GROUP BY 1),
c AS (SELECT chain, count(*) FILTER (WHERE contains(product || ' ' || lower(category), 'small')) AS t, count(*) FILTER (WHERE contains(product, 'gear')) AS p,
 count(*) FILTER (WHERE contains(product, 'gear') AND contains(product || ' ' || lower(category), 'small')) AS b FROM com GROUP BY 1),
j AS (SELECT coalesce(s.chain, c.chain) AS chain, coalesce(s.t, 0) AS st, coalesce(s.p, 0) AS sp, coalesce(c.t, 0) AS ct, coalesce(c.p, 0) AS cp, coalesce(c.b, 0) AS cb
 FROM s FULL JOIN c ON s.chain = c.chain)
SELECT chain, 'in-source-not-in-combined' AS problem FROM j WHERE st > 5 AND ct <= 2 UNION ALL SELECT chain, 'missing-in-source' FROM j WHERE st <= 2
UNION ALL SELECT chain, 'product-lost' FROM j WHERE sp > 0 AND cp = 0 UNION ALL SELECT chain, 'product-without-search-term' FROM j WHERE cp > 0 AND cb = 0
UNION ALL SELECT chain, 'reported-added-but-absent' FROM j WHERE st <= 2 AND chain IN ('EUROPE', 'ASIA')"""))
def import_problems(spark, sf):
    """Chains whose imports went wrong in each of the five ways."""
    offers = offers_view(spark, sf).select("chain", "product", "category")
    has_term = F.contains(F.concat_ws(" ", "product", F.lower("category")), F.lit("small"))
    gear = F.contains("product", F.lit("gear"))
    source = offers.filter(~((F.col("chain") == "EUROPE") & has_term))
    combined = offers.filter(
        (F.col("chain") != "ASIA") & ~((F.col("chain") == "AFRICA") & gear) & ~((F.col("chain") == "AMERICA") & gear & has_term)
    )
    added = spark.createDataFrame([("EUROPE", 12), ("ASIA", 3)], "chain string, added long")
    return verdicts.import_problems(source, combined, ["chain"], term="small", product="gear", added=added)


TRACED_SQL = with_offers(f"""
, s AS (SELECT id, "storeId", product, "packageSize", CASE WHEN "pageNumber" = 7 THEN NULL ELSE price END AS price, "unitPrice", "pageNumber",
  CASE WHEN confidence = 'low' THEN 1 ELSE 0 END AS src, suspect FROM offers),
j AS (SELECT *, CASE WHEN price IS NULL THEN 'no-price' WHEN suspect THEN 'suspect' WHEN "pageNumber" = 6 THEN 'no-product' WHEN "pageNumber" = 5 THEN 'marketing' END AS lost, {KEY} AS k FROM s),
two AS (SELECT id, src, lost, "storeId", k, "packageSize", price, "unitPrice", "pageNumber" FROM j
 UNION ALL SELECT id, 2, lost, "storeId", k, "packageSize", price, "unitPrice", "pageNumber" FROM j WHERE src = 0 AND contains(product, 'ring')),
w AS (SELECT *, CASE WHEN lost IS NULL THEN first_value(id) OVER (PARTITION BY lost, "storeId", k, "packageSize", price, "unitPrice", "pageNumber" ORDER BY src DESC, id DESC) END AS win,
 CASE WHEN lost IS NULL THEN first_value(src) OVER (PARTITION BY lost, "storeId", k, "packageSize", price, "unitPrice", "pageNumber" ORDER BY src DESC, id DESC) END AS wsrc FROM two)""")


@query("traced_sources", TRACED_SQL + """
SELECT ['feed one', 'feed two', 'feed three'][src + 1] AS "sourceFile", id, coalesce(lost, CASE WHEN win = id AND wsrc = src THEN 'kept' ELSE 'replaced' END) AS fate,
 CASE WHEN lost IS NULL AND NOT (win = id AND wsrc = src) THEN win END AS "replacedBy",
 CASE WHEN lost IS NULL AND NOT (win = id AND wsrc = src) THEN ['feed one', 'feed two', 'feed three'][wsrc + 1] END AS "replacedFrom" FROM w""")
def traced_sources(spark, sf):
    """What became of every row of three feeds, the third of which repeats a part of the first."""
    page = F.col("pageNumber")
    offers = offers_view(spark, sf).drop("category", "brand").withColumns({
        "price": F.when(page == 7, F.lit(None)).otherwise(F.col("price")),
        "rawContext": F.when(page == 5, F.lit("dnes vezměte si z regálu")).otherwise(F.lit("")),
        "compareKey": F.when(page == 6, F.lit("gone")).otherwise(F.lit("")), "ring": F.contains("product", F.lit("ring")), "product": F.when(page == 6, F.lit("")).otherwise(F.col("product")),
    })
    first = offers.filter("confidence <> 'low'")
    sources = {name: rows.drop("ring") for name, rows in {
        "feed one": first, "feed two": offers.filter("confidence = 'low'"), "feed three": first.filter("ring")}.items()}
    return verdicts.traced_sources(sources, ("sourceOrder", "id")).select("sourceFile", "id", "fate", "replacedBy", "replacedFrom")


@query("reconcile_tables", """
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders),
b AS (SELECT CASE WHEN k % 5 = 0 THEN -1 - k ELSE k END AS k, CASE WHEN k % 7 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN k % 3 = 0 THEN NULL ELSE status END AS status FROM a)
SELECT coalesce(a.k, b.k) AS id, CASE WHEN b.k IS NULL THEN 'lost' WHEN a.k IS NULL THEN 'new' WHEN a.price IS DISTINCT FROM b.price OR a.status IS DISTINCT FROM b.status THEN 'changed' ELSE 'same' END AS status,
 CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END, CASE WHEN a.status IS DISTINCT FROM b.status THEN 'state' END) END AS changed
FROM a FULL JOIN b ON a.k = b.k""")
def reconcile_tables(spark, sf):
    before = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"))
    k = F.col("id")
    after = before.select(
        F.when(k % 5 == 0, -1 - k).otherwise(k).alias("id"), F.when(k % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("state")).alias("state"),
    )
    return verdicts.reconcile_tables(before, after, ["id"], ["price", "state"]).withColumn("changed", F.array_join("changed", ","))


EXPECTED_SQL = f"""
, e AS (SELECT DISTINCT p_name || ' ' || p_type AS expected, p_brand AS list FROM part UNION SELECT 'nowhere ' || r_name || ' ' || n_name, 'absent' FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION SELECT 'small ring', 'present' UNION SELECT 'africa nothing', 'few'),
o AS (SELECT {t2("product || ' ' || brand || ' ' || category || ' ' || \"packageSize\" || ' ' || \"storeName\" || ' ' || \"storeId\" || ' ' || chain")} AS text, chain = 'ASIA' AS own FROM offers),
t AS (SELECT text, own, contains(text, 'ring') AS term, count(*) AS n FROM o GROUP BY ALL),
x AS (SELECT DISTINCT expected FROM e),
m AS (SELECT expected, CAST(coalesce(sum(n) FILTER (WHERE own), 0) AS BIGINT) AS c, CAST(coalesce(sum(n) FILTER (WHERE own AND term), 0) AS BIGINT) AS s, CAST(coalesce(sum(n), 0) AS BIGINT) AS a
 FROM x LEFT JOIN t ON len(list_filter(string_split({t2('expected')}, ' '), lambda w: length(w) >= 3 AND NOT contains(text, w))) = 0 GROUP BY 1)"""


def _expected(spark, sf):
    parts = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("expected"), F.col("p_brand").alias("list"))
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    absent = nations.select(F.concat_ws(" ", F.lit("nowhere"), "r_name", "n_name").alias("expected"), F.lit("absent").alias("list"))
    more = spark.createDataFrame([("small ring", "present"), ("africa nothing", "few")], "expected string, list string")
    return parts.unionByName(absent).unionByName(more).distinct()


@query("expected_report", with_offers(EXPECTED_SQL + ' SELECT expected, c AS "foundInChain", s AS "foundInSubset", a AS "foundInAll" FROM m'))
def expected_report(spark, sf):
    return verdicts.expected_report(offers_view(spark, sf), "asia", ["ring"], _expected(spark, sf))


@query("likely_problem", with_offers(EXPECTED_SQL + """
SELECT list, count(*) AS "expectedProducts", count(*) FILTER (WHERE c = 0) AS "missingInChain",
 CASE WHEN bool_or(a > 0 AND c = 0) THEN 'combine-or-store-tagging-problem' WHEN count(*) FILTER (WHERE c = 0) > 5 THEN 'import-missing-page-items' ELSE 'search-context-or-filter-problem' END AS "likelyProblem"
FROM e JOIN m USING (expected) GROUP BY list"""))
def likely_problem(spark, sf):
    """D16 for several lists at once: all three problems occur."""
    expected = _expected(spark, sf)
    report = verdicts.expected_report(offers_view(spark, sf), "asia", ["ring"], expected)
    return verdicts.likely_problem(expected.join(report, "expected"), ["list"])


@query("source_next_steps", """
WITH p AS (SELECT p_partkey AS page_id, p_size % 6 AS k FROM part)
SELECT page_id, ['repair-page-loading', 'parse-next-data', 'probe-endpoints', 'read-pdf-text', 'open-viewer-links', 'manual-review'][k + 1] AS "nextStep",
 CAST([6, 1, 2, 3, 4, 5][k + 1] AS INTEGER) AS "stepRank" FROM p""")
def source_next_steps(spark, sf):
    """D19 over pages of all six kinds; those that hold several kinds go by the best."""
    k = F.col("p_size") % 6
    parts = {
        1: '<script id="__NEXT_DATA__">{}</script><i data-x="/api/offers"></i>', 2: '<i data-x="/api/graphql"></i><a href="a.pdf">soubor</a>',
        3: '<a href="soubor.pdf">soubor</a><a href="x">katalog</a>', 4: '<a href="x">Prohlédnout</a>', 0: '<script id="__NEXT_DATA__">{}</script>',
    }
    body = F.lit("<p>nic</p>")
    for number, text in parts.items():
        body = F.when(k == number, F.lit(text)).otherwise(body)
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.lit("https://a.cz/").alias("url"), body.alias("html"), (k != 0).alias("ok"))
    potential = audit.source_potential(pages).join(pages.select("page_id", "ok"), "page_id")
    return verdicts.source_next_steps(potential, F.col("ok")).select("page_id", "nextStep", "stepRank")


@query("image_paths", """
WITH p AS (SELECT p_brand AS chain, p_partkey AS k, CAST(substr(p_brand, 7) AS INTEGER) % 5 AS kind FROM part)
SELECT chain, count(*) AS offers, count(*) FILTER (WHERE kind = 0) AS "existingImageFields", count(*) FILTER (WHERE kind = 1) AS "possibleProductImages",
 count(*) FILTER (WHERE kind = 3) AS "pageOrLeafletImages", count(*) FILTER (WHERE kind = 4) AS "decorativeOrCoverImages", count(*) FILTER (WHERE kind = 2) AS "nearbyProductCandidates",
 CASE any_value(kind) WHEN 0 THEN 'use-existing-offer-image-fields' WHEN 1 THEN 'map-product-images-from-html' WHEN 2 THEN 'map-product-images-from-html'
  WHEN 3 THEN 'page-image-crops-or-no-product-images' ELSE 'no-direct-product-images-found' END AS "recommendedPath" FROM p GROUP BY chain""")
def image_paths(spark, sf):
    kind = F.substring("p_brand", 7, 9).cast("int") % 5
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("chain"), F.col("p_partkey").cast("string").alias("k"), kind.alias("kind"))
    image = lambda folder: F.concat(F.lit(f"https://a.cz/{folder}/"), "k", F.lit(".jpg"))
    address = F.when(F.col("kind") == 1, image("product")).when(F.col("kind") == 3, image("prospekt")).when(F.col("kind") == 4, image("logo"))
    offers = rows.select("chain", F.when(F.col("kind") == 0, image("product")).otherwise(F.lit("")).alias("imageUrl"))
    images = rows.select("chain", address.alias("imageUrl")).filter("imageUrl is not null")
    nearby = rows.filter("kind = 2").select("chain", image("product").alias("imageUrl"))
    return verdicts.image_paths(offers, images, nearby).drop("testedImages")


@query("store_endpoints", """
SELECT s_suppkey AS id, 'https://a.cz/offers/' || s_suppkey::VARCHAR || '.json,https://b.cz/x?store=' || s_nationkey::VARCHAR AS endpoints, 'letak/' || s_suppkey::VARCHAR AS links FROM supplier""")
def store_endpoints(spark, sf):
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    html = F.concat(
        F.lit("<i data-a='/offers/"), key, F.lit(".json' data-b='https://b.cz/x?store="), nation, F.lit("' data-c='" + "store" * 70 + "'></i><a href=\"letak/"), key,
        F.lit('">Prospekt</a><a href="jinam">jinam</a>'),
    )
    pages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), html.alias("html"))
    return pages.select(
        "id", F.array_join(verdicts.store_endpoints("html", F.lit("https://a.cz/p/")), ",").alias("endpoints"),
        F.array_join(F.transform(verdicts.leaflet_links("html"), lambda a: a["href"]), ",").alias("links"),
    )
