"""Queries that join texts, pages, offers and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.functions import text as T
from pricewren.operators import match
from pricewren.operators.enrich import joined_text
from pricewren.plans import audit
from pricewren.workload.registry import query
from pricewren.workload.views import SEARCH_SQL, offers_view, t2, t3, table, wide_table, with_offers

CHECKS = [("rings", "small ring"), ("bolts", "BLUE  bolt"), ("brand four", "brand#4"), ("absent", "no such product")]


@query("key_occurrences", """
SELECT doc_id, b.text AS key, CAST(instr(d.text, b.text) - 1 AS INTEGER) AS pos,
 md5(substr(d.text, greatest(instr(d.text, b.text) - 50, 1), instr(d.text, b.text) + 100 - greatest(instr(d.text, b.text) - 50, 1))) AS context
FROM documents d, (SELECT DISTINCT text FROM benchmark) b WHERE contains(d.text, b.text)""")
def key_occurrences(spark, sf):
    keys = table(spark, sf, "benchmark").select(F.col("text").alias("key"))
    documents = wide_table(spark, sf, "documents", "doc_id", "text")
    found = match.key_occurrences(documents, keys, text_id="doc_id", text="text", key="key", before=50, after=100)
    return found.withColumn("context", F.md5("context"))


@query("match_expected", with_offers(f"""
, e AS (SELECT DISTINCT chain || ' ' || category AS term FROM offers),
o AS (SELECT id, {t2("product || ' ' || category || ' ' || chain")} AS text FROM offers),
d AS (SELECT text, count(*) AS n FROM o GROUP BY text)
SELECT term, CAST(sum(n) AS BIGINT) AS matches FROM e JOIN d ON
 len(list_filter(string_split({t2('term')}, ' '), lambda w: length(w) >= 3 AND NOT contains(text, w))) = 0 GROUP BY term"""))
def match_expected(spark, sf):
    offers = offers_view(spark, sf).select("id", T.normalize_search(F.concat_ws(" ", "product", "category", "chain")).alias("text"))
    texts = offers.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    expected = offers_view(spark, sf).select(F.concat_ws(" ", "chain", "category").alias("term")).distinct().withColumn("name", F.col("term"))
    pairs = match.match_expected(texts, expected, text_id="n", text="text", term_id="name", term="term")
    return pairs.groupBy(F.col("name").alias("term")).agg(F.sum("n").alias("matches"))


@query("match_checks", with_offers(f"""
, c(label, q) AS (VALUES ('rings', 'small ring'), ('bolts', 'blue bolt'), ('brand four', 'brand 4'), ('absent', 'no such product'))
SELECT label, count(*) AS matches, count(DISTINCT "pageNumber") AS pages FROM offers JOIN c ON contains({t2("product || ' ' || brand")}, q) GROUP BY label"""))
def match_checks(spark, sf):
    offers = offers_view(spark, sf)
    hits = match.match_checks(offers, T.normalize_search(F.concat_ws(" ", "product", "brand")), CHECKS)
    return hits.groupBy("label").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("pageNumber").alias("pages"))


@query("count_checks", with_offers(f"""
, c(label, q) AS (VALUES ('rings', 'small ring'), ('bolts', 'blue bolt'), ('brand four', 'brand 4'), ('absent', 'no such product'))
SELECT label, (SELECT count(*) FROM offers WHERE contains({t2("product || ' ' || brand")}, q)) AS matches FROM c"""))
def count_checks(spark, sf):
    return match.count_checks(offers_view(spark, sf), T.normalize_search(F.concat_ws(" ", "product", "brand")), CHECKS)


@query("attach_validity", """
WITH i AS (SELECT o_orderkey AS seq, (o_custkey % 1000)::VARCHAR AS kl, CASE WHEN o_orderkey > 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '' END AS df FROM orders),
d AS (SELECT kl, arg_max(df, seq) AS df FROM i GROUP BY kl), fb AS (SELECT arg_min(df, seq) AS df FROM i WHERE df <> '')
SELECT p_partkey AS id, coalesce(d.df, (SELECT df FROM fb)) AS "validFrom" FROM part LEFT JOIN d
 ON CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey::VARCHAR END = kl""")
def attach_validity(spark, sf):
    index = table(spark, sf, "orders").selectExpr(
        "o_orderkey as seq", "cast(o_custkey % 1000 as string) as klNr",
        "if(o_orderkey > 3, cast(cast(o_orderdate as date) as string), '') as dateFrom", "'' as dateTo",
    )
    offers = table(spark, sf, "part").selectExpr("p_partkey as id", "if(p_partkey % 3 = 0, '', cast(p_partkey as string)) as klNr")
    return match.attach_validity(offers, index, order="seq").select("id", "validFrom")


@query("pages_with_counts", """
WITH pages AS (SELECT p_partkey AS page, p_name AS text FROM part UNION ALL SELECT -1 - p_partkey, p_name FROM part),
c AS (SELECT l_partkey AS page, count(*) AS n FROM lineitem GROUP BY 1)
SELECT page, text, coalesce(n, 0) AS offers FROM pages LEFT JOIN c USING (page)""")
def pages_with_counts(spark, sf):
    """Every page twice: under its own number, and under a number that no offer has."""
    pages = table(spark, sf, "part").select(F.explode(F.array(F.col("p_partkey"), -1 - F.col("p_partkey"))).alias("page"), F.col("p_name").alias("text"))
    return match.pages_with_counts(pages, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("page")), "page")


def _candidates(spark, sf):
    """Candidates whose names sometimes extend, sometimes shorten a part's name; under negative ids, names that nothing has."""
    named = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 12).alias("pageNumber"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" extra"))).when(F.col("p_partkey") % 3 == 1, F.split("p_name", " ")[1])
        .otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("product"),
    )
    absent = named.select((-1 - F.col("id")).alias("id"), "pageNumber", F.concat(F.reverse("product"), F.lit(" zz"), F.col("id").cast("string")).alias("product"))
    return named.unionByName(absent)


def _known(spark, sf):
    return table(spark, sf, "part").select(
        ((F.col("p_partkey") * 7) % 14).cast("int").alias("pageNumber"), F.col("p_name").alias("product"), F.col("p_type").alias("category")
    )


CANDIDATES_SQL = """
WITH named AS (SELECT p_partkey AS id, p_size % 12 AS page, CASE p_partkey % 3 WHEN 0 THEN p_name || ' extra' WHEN 1 THEN split_part(p_name, ' ', 2)
  ELSE p_name || ' ' || p_brand END AS product FROM part),
c AS (SELECT * FROM named UNION ALL SELECT -1 - id, page, reverse(product) || ' zz' || id::VARCHAR FROM named),
k AS (SELECT CAST((p_partkey * 7) % 14 AS INTEGER) AS page, p_name AS product, p_type AS category FROM part)"""


@query("matches_existing", CANDIDATES_SQL + f"""
, n AS (SELECT id, page, {t2('product')} AS name FROM c), o AS (SELECT DISTINCT page, {t2("product || ' ' || category")} AS text, {t2('product')} AS name FROM k)
SELECT id, EXISTS (SELECT 1 FROM o WHERE o.page = n.page AND (contains(o.text, n.name) OR contains(n.name, o.name))) AS existing FROM n""")
def matches_existing(spark, sf):
    known = _known(spark, sf)
    text = T.normalize_search(F.concat_ws(" ", "product", "category"))
    return match.split_by_existing(_candidates(spark, sf), known, text).select("id", "existing")


@query("is_already_in", CANDIDATES_SQL + f"""
, n AS (SELECT DISTINCT page, {t3('product')} AS name FROM c), o AS (SELECT DISTINCT page, {t3("product || ' ' || category")} AS text FROM k),
w AS (SELECT *, list_slice(list_filter(string_split(name, ' '), lambda x: length(x) >= 4), 1, 3) AS ws FROM n)
SELECT page, name FROM w WHERE EXISTS (SELECT 1 FROM o WHERE (o.page = w.page OR w.page NOT IN (SELECT page FROM o))
 AND (contains(o.text, w.name) OR contains(w.name, o.text) OR (len(ws) >= 2 AND len(list_filter(ws, lambda x: NOT contains(o.text, x))) = 0)))""")
def is_already_in(spark, sf):
    text = T.normalize_loose(F.concat_ws(" ", "product", "category"))
    return match.already_in(_candidates(spark, sf), _known(spark, sf), text, T.normalize_loose)


TERMS = ["tion", "émentaux", "ingthe", "nothing like this"]


@query("terms_in_text_sources", """
WITH t AS (SELECT page_id, lower(strip_accents(url)) AS u, lower(strip_accents(html)) AS h FROM pages)
SELECT page_id, term FROM t, (VALUES ('ement'), ('tion'), ('thre')) x(term) WHERE contains(h, term)""")
def terms_in_text_sources(spark, sf):
    terms = spark.range(1).select(F.explode(F.array(F.lit("ément"), F.lit("tion"), F.lit("Thre"))).alias("raw"))
    terms = terms.withColumn("term", T.normalize_for_index("raw"))
    pages = wide_table(spark, sf, "pages", "page_id", "html")
    pairs = audit.terms_in_sources(pages, terms, source_id="page_id", value="html", term_id="term", term="term")
    return pairs.select("page_id", "term")


@query("term_hits", """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '[a-zA-Z_:][-a-zA-Z0-9_:.]*\\s*=\\s*["'']([^"'']+)["'']', 1)) AS v FROM pages)
SELECT page_id, term, count(DISTINCT v) > 0 AS found FROM a, (VALUES ('the'), ('example')) x(term) WHERE contains(lower(strip_accents(v)), term) GROUP BY ALL""")
def term_hits(spark, sf):
    sources = audit.text_sources(wide_table(spark, sf, "pages", "page_id", "html")).filter("kind = 'attribute'")
    hits = audit.term_hits(sources, ["the", "example"])
    return hits.groupBy("page_id", F.col("label").alias("term")).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("text_sources", """
SELECT page_id, 'attribute' AS kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '[a-zA-Z_:][-a-zA-Z0-9_:.]*\\s*=\\s*["''][^"'']+["'']')) FROM pages) GROUP BY 1
UNION ALL SELECT page_id, 'full-html-decoded', 1 FROM pages""")
def text_sources(spark, sf):
    sources = audit.text_sources(wide_table(spark, sf, "pages", "page_id", "html"))
    return sources.filter("kind in ('attribute', 'full-html-decoded')").groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("substring_join_offers", with_offers(f"""
, b AS (SELECT DISTINCT p_brand || ' ' || p_type AS q FROM part)
, t AS (SELECT {SEARCH_SQL} AS text, count(*) AS n FROM offers GROUP BY 1), k AS (SELECT q, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS needle FROM b)
SELECT q, CAST(sum(n) AS BIGINT) AS matches FROM t JOIN k ON contains(text, needle) GROUP BY q"""))
def substring_join_offers(spark, sf):
    """Search-box queries kept in a table, run against every offer at once."""
    offers = offers_view(spark, sf)
    texts = offers.select(T.normalize_ascii(joined_text(offers)).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    queries = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("q")).distinct()
    needles = queries.withColumn("_parts", F.array(T.normalize_ascii("q")))
    pairs = match.substring_join(texts, needles, text_id="n", text="text", needle_id="q", parts="_parts")
    return pairs.groupBy("q").agg(F.sum("n").alias("matches"))
