"""Queries over documents and pages: text normalisation and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.functions import html as H, names as N, text as T
from pricewren.operators import lines as L
from pricewren.workload.registry import query
from pricewren.workload.views import (
    code_sql, entities_sql, squeeze_sql, strip_tags_sql, t1, t2, t3, table, uri_sql, wide_table,
)


def documents(spark, sf):
    return wide_table(spark, sf, "documents")


def pages(spark, sf):
    return wide_table(spark, sf, "pages")


def _document_text(name, build, sql):
    @query(name, f"SELECT doc_id, md5({sql}) AS digest, CAST(length({sql}) AS BIGINT) AS size FROM documents")
    def run(spark, sf):
        return documents(spark, sf).select("doc_id", build(F.col("text")).alias("v")).select(
            "doc_id", F.md5("v").alias("digest"), F.length("v").cast("bigint").alias("size")
        )


_DASHED = "replace(replace(text, chr(160), ' '), '—', '–')"
_TRIMMED = "trim(regexp_replace(replace({0}, chr(13), ''), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
_document_text("normalize_ascii", T.normalize_ascii, t1("text"))
_document_text("normalize_search", T.normalize_search, t2("text"))
_document_text("normalize_loose", T.normalize_loose, t3("text"))
_document_text("normalize_for_index", T.normalize_for_index, "replace(replace(lower(strip_accents(text)), '–', '-'), '—', '-')")
_document_text("normalize_text", T.normalize_text, _TRIMMED.format(_DASHED))
_document_text("compact_text", T.compact_text, squeeze_sql("regexp_replace(text, '\\r?\\n', ' | ', 'g')"))
_document_text("strip_document_tags", H.strip_tags, strip_tags_sql("text"))


@query("normalize_line", f"""
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, {squeeze_sql("regexp_replace(line, '^-\\s*', '')")} AS line FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 LATERAL (SELECT {_TRIMMED.format("replace(raw, '—', '–')")} AS line)""")
def normalize_line(spark, sf):
    lines = L.explode_lines(documents(spark, sf), F.split("text", "\n"), ["doc_id"])
    return lines.select("doc_id", "pos", T.normalize_line("line").alias("line"))


@query("decode_html", f"SELECT page_id, md5({entities_sql('html')}) AS digest FROM pages")
def decode_html(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(H.decode_html("html", script_escapes=False)).alias("digest"))


@query("decode_numeric_entities", """
SELECT n_nationkey AS id, r_regionkey AS region, chr(192 + n_nationkey * 7 + r_regionkey * 300) || ' ' || n_name || chr(192 + n_nationkey * 7 + r_regionkey * 300)
 AS text, p_partkey FROM nation CROSS JOIN region JOIN part ON p_partkey % 25 = n_nationkey AND p_partkey % 5 = r_regionkey""")
def decode_numeric_entities(spark, sf):
    parts = table(spark, sf, "part").withColumns({"id": F.expr("cast(p_partkey % 25 as int)"), "region": F.expr("cast(p_partkey % 5 as int)")})
    named = parts.join(table(spark, sf, "nation"), F.col("id") == F.col("n_nationkey"))
    code = F.col("id") * 7 + F.col("region") * 300 + 192
    text = F.concat(F.lit("&#"), code.cast("string"), F.lit("; "), "n_name", F.lit("&#x"), F.lower(F.hex(code)), F.lit(";"))
    return named.select("id", "region", H.decode_html(text).alias("text"), "p_partkey")


@query("decode_url", """
SELECT p_partkey AS id, 'q=' || p_name || '+' || p_brand AS text FROM part""")
def decode_url(spark, sf):
    twice = F.concat(F.lit("q="), F.replace("p_name", F.lit(" "), F.lit("%2520")), F.lit("+"), F.replace("p_brand", F.lit("#"), F.lit("%23")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.decode_url(twice).alias("text"))


@query("strip_tags", f"SELECT page_id, md5({strip_tags_sql('html')}) AS digest FROM pages")
def strip_tags(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(H.strip_tags("html")).alias("digest"))


def _lines_sql(source: str, clean: str) -> str:
    return f"""
SELECT page_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS pos, unnest(ls) AS line FROM (
 SELECT page_id, list_filter(list_transform(string_split_regex({source}, '\\n+'), lambda l: {clean}), lambda l: l <> '') AS ls FROM pages)"""


_HEADED = code_sql("html", "")
for _p, _b in (("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "\n### \\1\n"), ("(?i)<li[^>]*>", "\n* "),
               ("(?i)</li>|<br\\s*/?>|</(?:p|div|section|article|ul|ol|a)>", "\n"), ("<[^>]+>", " ")):
    _HEADED = f"regexp_replace({_HEADED}, '{_p}', '{_b}', 'g')"


@query("html_to_lines", _lines_sql(entities_sql(_HEADED), f"trim(regexp_replace({squeeze_sql('l')}, '^[-*]\\s*', ''))"))
def html_to_lines(spark, sf):
    return L.explode_lines(pages(spark, sf), H.html_to_lines("html"), ["page_id"])


@query("block_lines", _lines_sql(entities_sql(
    "regexp_replace(regexp_replace(" + code_sql("html", "\n")
    + ", '(?i)<br\\s*/?>|</(?:p|div|section|article|li|h1|h2|h3|h4|span|a)>', '\n', 'g'), '<[^>]+>', ' ', 'g')"), squeeze_sql("l")))
def block_lines(spark, sf):
    return L.explode_lines(pages(spark, sf), H.block_lines("html"), ["page_id"])


@query("extract_paragraphs", f"""
WITH d AS (SELECT page_id, {uri_sql(entities_sql('html'))} AS html FROM pages),
p AS (SELECT page_id, unnest(list_distinct(list_concat(
  list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {strip_tags_sql('x')}),
   lambda x: length(x) >= 50), CASE WHEN length({strip_tags_sql('html')}) > 300 THEN [{strip_tags_sql('html')}] ELSE [] END))) AS text FROM d)
SELECT page_id, md5(text) AS digest, CAST(length(text) AS INTEGER) AS size FROM p""")
def extract_paragraphs(spark, sf):
    texts = pages(spark, sf).select("page_id", F.explode(H.extract_paragraphs("html")).alias("t"))
    return texts.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("size"))


@query("extract_attributes", """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '[a-zA-Z_:][-a-zA-Z0-9_:.]*\\s*=\\s*["''][^"'']+["'']')) AS m FROM pages)
SELECT page_id, trim(split_part(m, '=', 1)) AS name, count(*) AS n, count(DISTINCT m) AS distinct_values FROM a GROUP BY 1, 2""")
def extract_attributes(spark, sf):
    found = pages(spark, sf).select("page_id", F.inline(H.extract_attributes("html")))
    return found.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw").alias("distinct_values"))


@query("extract_meta_text", """
WITH v AS (SELECT page_id, unnest(regexp_extract_all(html,
 '(?i)(?:content|title|alt|aria-label|href|src|data-[\\w-]+)\\s*=\\s*["'']([^"'']+)["'']', 1)) AS raw FROM pages),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(raw, '^[^ ]*/[^ ]*', ''), '\\s+', ' ', 'g')) AS t FROM v)
SELECT p.page_id, coalesce(m.words, 0) AS words FROM pages p LEFT JOIN
 (SELECT page_id, count(DISTINCT t) AS words FROM c WHERE length(t) > 12 GROUP BY 1) m USING (page_id)""")
def extract_meta_text(spark, sf):
    # The pages carry hardly any prose in attributes, so the check is on the count.
    meta = pages(spark, sf).select("page_id", H.extract_meta_text("html").alias("m"))
    return meta.select("page_id", F.when(F.col("m") == "", 0).otherwise(1).cast("bigint").alias("words"))


@query("extract_percent_fragments", """
SELECT p_partkey AS id, 'percent-fragment' AS kind, p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size::VARCHAR || ' end of text' AS value
FROM part WHERE length(p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size::VARCHAR || ' end of text') > 30""")
def extract_percent_fragments(spark, sf):
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("end of text"))
    encoded = F.replace(F.replace(text, F.lit("#"), F.lit("%23")), F.lit(" "), F.lit("%20"))
    html = F.concat(F.lit('<meta name="x" content="'), encoded, F.lit('">'))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.inline(H.extract_percent_fragments(html)))


@query("extract_links", f"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href\\s*=\\s*["''][^"'']+["''][^>]*>.*?</a>')) AS m FROM pages)
SELECT page_id, trim(regexp_extract(m, '(?is)href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS href,
 {entities_sql(squeeze_sql("regexp_replace(regexp_extract(m, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g')"))} AS text, count(*) AS n
FROM a GROUP BY ALL""")
def extract_links(spark, sf):
    links = pages(spark, sf).select("page_id", F.inline(H.extract_links("html")))
    return links.groupBy("page_id", "href", "text").agg(F.count(F.lit(1)).alias("n"))


@query("extract_asset_urls", f"""
WITH d AS (SELECT page_id, {entities_sql('html')} AS html FROM pages)
SELECT page_id, CAST(len(list_distinct(list_filter(list_concat(
 list_transform(regexp_extract_all(html, '(?i)(?:src|href|data-src|data-href|data-url|data-lazy|data-original|data-image|content|poster)\\s*=\\s*["'']([^"'']+)["'']', 1), lambda u: trim(u)),
 list_transform(regexp_extract_all(html, '(?i)https?://[^"''\\\\\\s)<>]+'), lambda u: regexp_replace(u, '[;,]+$', ''))), lambda u: u <> ''))) AS INTEGER) AS urls FROM d""")
def extract_asset_urls(spark, sf):
    return pages(spark, sf).select("page_id", F.size(H.extract_asset_urls("html")).alias("urls"))


@query("resolve_url", """
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS href FROM pages)
SELECT page_id, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || href ELSE href END AS address, count(*) AS n
FROM a GROUP BY ALL""")
def resolve_url(spark, sf):
    hrefs = pages(spark, sf).select("page_id", "url", F.explode(H.extract_links("html")).alias("link"))
    absolute = hrefs.select("page_id", H.resolve_url("link.href", "url").alias("address"))
    return absolute.groupBy("page_id", "address").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_relative_url", """
SELECT p_partkey AS id, 'https://shop.example/' || p_type || '/list/item-' || p_partkey::VARCHAR || '.html?size=' || p_size::VARCHAR AS address FROM part""")
def resolve_relative_url(spark, sf):
    base = F.concat(F.lit("https://shop.example/"), "p_type", F.lit("/page/1.html?x=1"))
    href = F.concat(F.lit("./../list/x/../item-"), F.col("p_partkey").cast("string"), F.lit(".html?size="), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), H.resolve_url(href, base).alias("address"))


@query("extract_embedded_json", "SELECT event_id, 'script-json' AS kind, props AS body, CAST(props->>'k' AS INTEGER) AS k FROM events")
def extract_embedded_json(spark, sf):
    html = F.concat(F.lit('<head><script type="application/ld+json">'), "props", F.lit("</script></head><body>"), "event_type", F.lit("</body>"))
    found = table(spark, sf, "events").select("event_id", F.inline(H.extract_embedded_json(html)))
    return found.withColumn("k", F.get_json_object("body", "$.k").cast("int"))


@query("snippet", f"""
WITH d AS (SELECT doc_id, {squeeze_sql("replace(text, '—', '–')")} AS s FROM documents),
p AS (SELECT doc_id, s, instr(lower(strip_accents(s)), 'ement') AS pos FROM d)
SELECT doc_id, CASE WHEN pos > 0 THEN substr(s, greatest(pos - 40, 1), pos + 45 - greatest(pos - 40, 1)) ELSE '' END AS snippet FROM p""")
def snippet(spark, sf):
    return documents(spark, sf).select("doc_id", T.snippet("text", F.lit("éMENT"), 40).alias("snippet"))


@query("context_around", f"""
WITH p AS (SELECT doc_id, text, instr(lower(strip_accents(text)), 'tion') AS pos FROM documents)
SELECT doc_id, CASE WHEN pos > 0 THEN {squeeze_sql("regexp_replace(substr(text, greatest(pos - 60, 1), pos + 60 - greatest(pos - 60, 1)), '\\r?\\n', ' | ', 'g')")}
 ELSE '' END AS context FROM p""")
def context_around(spark, sf):
    at = F.instr(T.normalize_for_index("text"), F.lit("tion"))
    return documents(spark, sf).select("doc_id", T.context_around("text", at, 60).alias("context"))


@query("flexible_position", """
SELECT doc_id, regexp_matches(lower(strip_accents(text)), '(?s)the.{0,80}and') AS found FROM documents""")
def flexible_position(spark, sf):
    return documents(spark, sf).select("doc_id", (T.flexible_position("text", F.lit("the and")) > 0).alias("found"))


@query("remove_page_noise", """
SELECT p_partkey AS id, p_name || ' ' || p_size::VARCHAR || ' g' AS text FROM part""")
def remove_page_noise(spark, sf):
    noisy = F.concat(
        F.lit(" "), F.col("p_size").cast("string"), F.lit("  nízké ceny hezky česky "), "p_name",
        F.lit(" < Nejnižší cena za posledních 30 dní ilustrační foto "), F.col("p_size").cast("string"), F.lit(" g Made with FlippingBook "),
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), T.remove_page_noise(noisy, F.col("p_size")).alias("text")
    )


@query("longest_price_line", """
SELECT p_partkey AS id, 'cena za 1 kg ' || p_name || ' ' || p_size::VARCHAR || ',90 Kč ' || p_brand AS line FROM part""")
def longest_price_line(spark, sf):
    size = F.col("p_size").cast("string")
    lines = F.array(
        F.concat("p_name", F.lit(" "), "p_brand", F.lit(" and a long line without any price at all, just words")),
        F.concat(size, F.lit(",90 Kč")),
        F.concat(F.lit("cena za 1 kg "), "p_name", F.lit(" "), size, F.lit(",90 Kč "), "p_brand"),
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.longest_price_line(lines).alias("line"))


# --- addresses ---------------------------------------------------------------
@query("classify_url", """
WITH a AS (SELECT page_id, unnest(list_concat([url], regexp_extract_all(html, '(?is)<a\\b[^>]*href\\s*=\\s*["'']([^"'']+)["'']', 1))) AS u FROM pages)
SELECT CASE WHEN regexp_matches(u, '(?i)logo|icon|sprite|favicon|placeholder|pagestub|fbthumb|cover') THEN 'decorative-or-cover'
 WHEN regexp_matches(u, '(?i)leaflet|page|publication|catalog|brochure|prospekt') THEN 'page-or-leaflet-image'
 WHEN regexp_matches(u, '(?i)product|media|image|img|asset|cdn|usercontent') THEN 'possible-product-image' ELSE 'unknown-image' END AS kind,
 count(*) AS n FROM a GROUP BY 1""")
def classify_url(spark, sf):
    links = F.transform(H.extract_links("html"), lambda l: l["href"])
    urls = pages(spark, sf).select(F.explode(F.concat(F.array("url"), links)).alias("u"))
    return urls.groupBy(H.classify_image("u").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("classify_asset", """
SELECT page_id, array_to_string(list_filter([
 CASE WHEN regexp_matches(url, '(?i)\\.html?(?:[?#].*)?$|/\\d+/?$') THEN 'html' END,
 CASE WHEN regexp_matches(url, '(?i)\\.js(?:[?#].*)?$') THEN 'script' END,
 CASE WHEN regexp_matches(url, '(?i)\\.json(?:[?#].*)?$|/api/|\\.api|manifest|data') THEN 'json' END,
 CASE WHEN regexp_matches(url, '(?i)leaflet|page-|page_|catalog|brochure|prospekt') THEN 'leaflet' END], lambda x: x IS NOT NULL), ',') AS kinds
FROM pages""")
def classify_asset(spark, sf):
    return pages(spark, sf).select("page_id", F.array_join(H.classify_asset("url"), ",").alias("kinds"))


@query("canonical_image_url", "SELECT page_id, split_part(url, '?', 1) AS image FROM pages")
def canonical_image_url(spark, sf):
    return pages(spark, sf).select("page_id", H.canonical_image_url("url").alias("image"))


@query("page_number", """
SELECT page_id, CASE WHEN page_id % 3 = 1 THEN CAST(page_id AS INTEGER) ELSE CAST(page_id + 5 AS INTEGER) END AS page FROM pages""")
def page_number(spark, sf):
    rows = pages(spark, sf).selectExpr(
        "page_id", "if(page_id % 3 = 1, page_id, if(page_id % 3 = 0, 0, -1)) as pageNumber",
        "concat('https://files/', page_id + 5, '/index.html') as sourceUrl",
    )
    return rows.select("page_id", H.page_number("pageNumber", address="sourceUrl").alias("page"))


@query("best_page_image", """
SELECT page_id, 'https://v.example/1/2/pages/p' || page_id::VARCHAR || '-at' || CASE WHEN page_id % 2 = 0 THEN '1600' ELSE '800' END || '.jpg' AS image FROM pages""")
def best_page_image(spark, sf):
    stem = F.concat(F.lit("https://v.example/1/2/pages/p"), F.col("page_id").cast("string"), F.lit("-at"))
    sizes = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("400"), F.lit("1600"), F.lit("1200"))).otherwise(F.array(F.lit("800"), F.lit("400"), F.lit("9999")))
    return pages(spark, sf).select("page_id", H.best_page_image(F.transform(sizes, lambda s: F.concat(stem, s, F.lit(".jpg")))).alias("image"))


@query("category_from_url", """
SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'Akční nabídka' ELSE p_type || ' / ' || replace(p_name, '_', ' ') END AS category FROM part""")
def category_from_url(spark, sf):
    value = F.when(F.col("p_size") % 7 == 0, F.lit("0001_TopArticle")).otherwise(
        F.concat(F.lit("0042_"), "p_type", F.lit("__"), F.replace("p_name", F.lit(" "), F.lit("_")))
    )
    url = F.concat(F.lit("https://shop.example/list.html?week=current&amp;kloffer-category="), value, F.lit("#top"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), H.category_from_url(url).alias("category"))


# --- line windows ------------------------------------------------------------
@query("line_block_ids", """
WITH l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS pos, unnest(ls) AS line FROM
 (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS lines, min(pos) AS first_pos FROM
 (SELECT *, sum(CASE WHEN length(line) < 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l) GROUP BY ALL""")
def line_block_ids(spark, sf):
    rows = L.explode_lines(documents(spark, sf), F.split("text", "\n"), ["doc_id"])
    blocks = L.with_block_id(rows, ["doc_id"], F.length("line") < 30)
    return blocks.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("pos").alias("first_pos"))


@query("line_neighbours", """
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
m AS (SELECT doc_id, CAST(pos * 100 AS INTEGER) AS s, CAST(pos * 100 + length(line) AS INTEGER) AS e FROM l WHERE contains(line, 'tion'))
SELECT doc_id, s AS "start", e AS "end", coalesce(lag(e) OVER w, 0) AS prev_end, lead(s) OVER w AS next_start FROM m
WINDOW w AS (PARTITION BY doc_id ORDER BY s)""")
def line_neighbours(spark, sf):
    rows = L.explode_lines(documents(spark, sf), F.split("text", "\n"), ["doc_id"]).filter(F.contains("line", F.lit("tion")))
    marks = rows.select("doc_id", ((F.col("pos") + 1) * 100).alias("start"), ((F.col("pos") + 1) * 100 + F.length("line")).alias("end"))
    return L.with_neighbours(marks, ["doc_id"])


@query("line_windows", """
WITH l AS (SELECT page_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS pos, unnest(ls) AS line FROM
 (SELECT page_id, string_split(html, '</p>') AS ls FROM pages))
SELECT page_id, pos, md5(string_agg(line, ' ') OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)) AS digest FROM l""")
def line_windows(spark, sf):
    rows = L.explode_lines(pages(spark, sf), F.split("html", "</p>"), ["page_id"])
    return L.with_line_window(rows, ["page_id"], 3, 4).select("page_id", "pos", F.md5("context").alias("digest"))


@query("page_ordinals", """
SELECT conv_id, role, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS ordinal FROM conversations""")
def page_ordinals(spark, sf):
    numbered = L.with_ordinal(table(spark, sf, "conversations"), ["conv_id", "role"], "turn")
    return numbered.select("conv_id", "role", "turn", F.col("ordinal").cast("int").alias("ordinal"))


@query("line_predicates", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '(?i)\\d{1,4}(?:\\s?\\d{3})*,\\d{2}\\s*Kč')
  OR (regexp_matches(' ' || regexp_replace(line, '[^\\p{L}\\p{N}_]', '  ', 'g') || ' ', '(?i) (kg|g|l|ml|ks) ') AND length(line) > 6 AND length(line) < 120)) AS product_like,
 count(*) FILTER (WHERE regexp_matches(trim(line), '(?i)^(\\d{1,4}(?:[,.]\\d{2})?|\\d{1,4},-|[-+]?\\d+\\s*%|S \\d+ BODY|\\d{1,2}\\s+\\d{2})$')) AS price_only,
 count(*) FILTER (WHERE regexp_matches(line, '^\\s*•')) AS bullets FROM l GROUP BY 1""")
def line_predicates(spark, sf):
    rows = L.explode_lines(documents(spark, sf), F.split("text", "\n"), ["doc_id"])
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(H.product_like(F.col("line"))).alias("product_like"),
        F.count_if(N.price_only_line(F.col("line"))).alias("price_only"), F.count_if(N.bullet_line(F.col("line"))).alias("bullets"),
    )


@query("store_hints", """
SELECT s_suppkey AS id, 'shop-' || s_suppkey::VARCHAR || ',' || s_nationkey::VARCHAR || 'x' AS hints FROM supplier""")
def store_hints(spark, sf):
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    html = F.concat(F.lit('<div data-storeId="shop-'), key, F.lit('">x</div><script>var branch = "'), nation, F.lit('x"; storeName: shop-'), key, F.lit(";</script>"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(H.store_hints(html), ",").alias("hints"))


@query("endpoint_hints", """
SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html,
 '(?i)["'']([^"'']*(?:api|graphql|product|products|offers|leaflet|catalog|brochure)[^"'']*)["'']', 1))) AS INTEGER) AS hints FROM pages""")
def endpoint_hints(spark, sf):
    return pages(spark, sf).select("page_id", F.size(H.endpoint_hints("html")).alias("hints"))
