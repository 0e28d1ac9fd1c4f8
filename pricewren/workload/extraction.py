"""Queries that extract offers from leaflet pages written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.functions import html as H, money as M, names as N
from pricewren.operators import extract as X, reconcile as R
from pricewren.workload.registry import query
from pricewren.workload.views import LINE_KEY, amount_sql, amount_text, dealt_parts, row_key, table, wide_table

# Leaflet rows: lineitem with its part; unit price per 100 g, size in whole hundreds of grams.
LEAFLET_SQL = """
WITH rows AS (SELECT *, unit_cents * (amount // 100) AS pack_cents FROM (
 SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR
  || '-' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS page_id, l_linenumber AS page_number, upper(p_name) AS name, p_name, p_brand, p_type,
  (p_size % 9 + 1) * 100 AS amount, ((l_partkey * 37 + l_suppkey * 11) % 29 + 1) * 100 + 90 AS unit_cents
 FROM lineitem JOIN part ON l_partkey = p_partkey))
"""


def leaflets(spark, sf, dealt=True):
    rows = wide_table(spark, sf, "lineitem", *LINE_KEY).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # The pages are written here: narrow rows are dealt out before their texts grow. A table of pages is read as it lies.
    # ``once_per_page`` deals out the distinct pages itself.
    return (rows.repartition("l_orderkey", "l_linenumber") if dealt else rows).select(
        row_key().alias("page_id"), F.col("l_linenumber").alias("page_number"), F.upper("p_name").alias("name"), "p_name", "p_brand", "p_type",
        ((F.col("p_size") % 9 + 1) * 100).alias("amount"),
        (((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 29 + 1) * 100 + 90).alias("unit_cents"),
    ).withColumn("pack_cents", F.expr("unit_cents * (amount div 100)"))


def _t(*parts):
    """Concatenate columns and literals (``@name`` is a column, ``#name`` a money amount)."""
    out = []
    for p in parts:
        if p.startswith("@"):
            out.append(F.col(p[1:]).cast("string"))
        elif p.startswith("#"):
            out.append(amount_text(F.col(p[1:])))
        else:
            out.append(F.lit(p))
    return F.concat(*out)


@query("extract_heading_blocks", LEAFLET_SQL + """
SELECT page_id, p_name AS product, amount::VARCHAR || ' g' AS "packageSize", pack_cents / 100 AS price, 'akční cena' AS "priceType",
 unit_cents / 100 AS "unitPrice", 'Kč/100 g' AS unit FROM rows
UNION ALL SELECT page_id, p_brand || ' ' || p_type, '', (unit_cents + 1000) / 100, 's kartou', (unit_cents + 1000) / 100, 'Kč/ks' FROM rows""")
def extract_heading_blocks(spark, sf):
    html = _t(
        "<html><script>var a = 1;</script><h1>Akční nabídka</h1><p>9,90 Kč</p><h2>", "@p_name", "</h2><ul><li>", "@amount", " g</li><li>",
        "#pack_cents", " Kč 999,90 Kč</li><li>100 g ", "#unit_cents", " Kč</li></ul><h2><b>", "@p_brand", "</b> ", "@p_type",
        "</h2><p>1 999,90 Kč</p><p>s PENNY kartou</p><div>",
    )
    html = F.concat(html, amount_text(F.col("unit_cents") + 1000), F.lit(" Kč</div><h3>Bez ceny</h3><p>nic</p></html>"))
    pages = leaflets(spark, sf, dealt=False).select("page_id", html.alias("html"))
    offers = X.once_per_page(pages, lambda p, keep: X.extract_heading_blocks(p, keep=keep), ["html"])
    return offers.select("page_id", "product", "packageSize", "price", "priceType", "unitPrice", "unit")


def _segment_pages(spark, sf):
    line = _t(
        "@page_number", " nízké ceny hezky česky 69,90 279,90/ 25% ", "#pack_cents", " ", "@name", " různé druhy ", "@amount", " g 100 g ",
        "#unit_cents", " Kč < 8,90 Kč BANÁNY cena za 1 kg ", "@name", " EXTRA chlazené 2 kg 1 kg ", "#unit_cents", " Kč Nabídka platná do úterý 19. 5. 2026",
    )
    return leaflets(spark, sf, dealt=False).select("page_id", "page_number", line.alias("line"))


def _reconciled(spark, sf):
    return X.once_per_page(
        _segment_pages(spark, sf), lambda p, keep: R.reconcile_segments(X.extract_unit_segments(p, keep=keep)), ["page_number", "line"]
    )


@query("extract_unit_segments", LEAFLET_SQL + """
SELECT page_id, 0 AS ordinal, name AS product, amount::VARCHAR || ' g' AS "packageSize", '100 g' AS "unitBase", unit_cents / 100 AS "unitPrice",
 2 AS leads, DATE '2026-05-19' AS "validTo" FROM rows
UNION ALL SELECT page_id, 1, name || ' EXTRA', '2 kg', '1 kg', unit_cents / 100, 2, DATE '2026-05-19' FROM rows""")
def extract_unit_segments(spark, sf):
    segments = X.once_per_page(_segment_pages(spark, sf), lambda p, keep: X.extract_unit_segments(p, keep=keep), ["page_number", "line"])
    return segments.select(
        "page_id", "ordinal", "product", "packageSize", "unitBase", F.get("unitPrices", F.lit(0)).alias("unitPrice"),
        F.size("leadPrices").alias("leads"), "validTo",
    )


# Two segments a page: the first is priced by the lead price, the second lies up to 200 Kč from the nearest one (69,90 or the first's).
SEGMENTS_SQL = LEAFLET_SQL + """
, s AS (SELECT page_id, 0 AS ordinal, name AS product, pack_cents AS cents, 0 AS diff, unit_cents FROM rows
 UNION ALL SELECT page_id, 1, name || ' EXTRA', 2 * unit_cents, least(abs(2 * unit_cents - 6990), abs(2 * unit_cents - pack_cents)), unit_cents FROM rows),
j AS (SELECT *, concat_ws(',', CASE WHEN cents > 99900 THEN 'very-high-price' END, CASE WHEN diff > 2000 THEN 'computed-price-far-from-nearest-lead-price' END,
 CASE WHEN cents >= 8000 AND diff > 1500 THEN 'small-package-high-price' END) AS reasons FROM s)"""


@query("reconcile_segments", SEGMENTS_SQL + """
SELECT page_id, ordinal, product, cents / 100 AS price, unit_cents / 100 AS "unitPrice", 'computed' AS source, reasons, reasons <> '' AS suspect FROM j""")
def reconcile_segments(spark, sf):
    offers = _reconciled(spark, sf)
    return offers.select(
        "page_id", "ordinal", "product", F.round("price", 2).alias("price"), "unitPrice", F.col("debug.source").alias("source"),
        F.array_join("suspectReasons", ",").alias("reasons"), "suspect",
    )


@query("reconciled_confidence", SEGMENTS_SQL + """
SELECT page_id, ordinal, CASE WHEN reasons <> '' THEN 'medium' WHEN length(product) <= 8 THEN 'low' WHEN diff <= 15 THEN 'high' ELSE 'medium' END AS confidence,
 diff / 100 AS diff FROM j""")
def reconciled_confidence(spark, sf):
    offers = _reconciled(spark, sf)
    return offers.select("page_id", "ordinal", "confidence", F.round("debug.diff", 2).alias("diff"))


def _bullet_pages(spark, sf):
    text = _t(
        "AKČNÍ NABÍDKA\n", "@name", "\n199,90\n• vybrané druhy\n• ", "@amount", " g\n• 100 g = ", "#unit_cents", " Kč\nSUPER CENA\n", "@p_brand", " ",
        "@name", "\nzrnková\n• originál\n• 1 kg = 99,90 Kč\n• ", "@amount", " g\n• ", "#pack_cents", " Kč\nbez bullet\n• jen text\n",
    )
    return leaflets(spark, sf, dealt=False).select("page_id", "page_number", "pack_cents", text.alias("text"))


def _bullet_offers(spark, sf):
    # The page number goes into the id alone, which no query here returns.
    def blocks(pages, keep):
        return X.extract_bullet_blocks(pages.withColumn("page_number", F.lit(0)), keep=keep).drop("page_number", "id")

    return X.once_per_page(_bullet_pages(spark, sf), blocks, ["text"])


RETAIL = """CASE WHEN c % 100 BETWEEN 91 AND 94 THEN c // 100 + 0.9 WHEN c % 100 BETWEEN 96 AND 99 THEN CAST(c // 100 + 1 AS DOUBLE)
 WHEN c % 100 BETWEEN 1 AND 4 THEN CAST(c // 100 AS DOUBLE) ELSE c / 100 END"""


@query("extract_bullet_blocks", LEAFLET_SQL + f"""
, c AS (SELECT *, CAST(floor(unit_cents / 100 * (amount / 100) * 100 + 0.5) AS BIGINT) AS c FROM rows)
SELECT page_id, name AS product, '' AS description, amount::VARCHAR || ' g' AS "packageSize", CAST({RETAIL} AS DOUBLE) AS price,
 unit_cents / 100 AS "unitPrice", 'Kč/100 g' AS unit FROM c
UNION ALL SELECT page_id, p_brand || ' ' || name || ' zrnková', 'originál', '1 kg',
 CAST((SELECT {RETAIL} FROM (SELECT pack_cents AS c)) AS DOUBLE), 99.9, 'Kč/1 kg' FROM rows WHERE pack_cents < 1000000""")
def extract_bullet_blocks(spark, sf):
    # A main price equal to the unit price cannot be told apart from it; such pages fall back to the computed price, which is the same.
    offers = _bullet_offers(spark, sf)
    return offers.select("page_id", "product", "description", "packageSize", "price", "unitPrice", "unit")


@query("classify_quality_reasons", LEAFLET_SQL + """
SELECT confidence, suspect, count(*) AS offers FROM (
 SELECT CASE WHEN p < 2 THEN 'low' ELSE 'medium' END AS confidence, p < 2 AS suspect FROM (SELECT unnest([unit_cents / 100 * (amount / 100), pack_cents / 100]) AS p FROM rows)
) GROUP BY ALL""")
def classify_quality_reasons(spark, sf):
    offers = _bullet_offers(spark, sf)
    return offers.groupBy("confidence", "suspect").agg(F.count(F.lit(1)).alias("offers"))


@query("final_clean", LEAFLET_SQL + """
SELECT page_id, name || CASE WHEN amount % 200 = 0 THEN ' 5 ml' ELSE '' END AS product, amount % 200 = 0 AS suspect,
 CASE WHEN amount % 200 = 0 THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN amount % 200 = 0 THEN 'finální filtr: jiné balení v názvu než packageSize' ELSE '' END AS reasons FROM rows""")
def final_clean(spark, sf):
    rows = leaflets(spark, sf).select(
        "page_id", F.concat("name", F.when(F.col("amount") % 200 == 0, F.lit(" 5 ml")).otherwise(F.lit(""))).alias("product"),
        _t("@amount", " g").alias("packageSize"), (F.col("pack_cents") / 100).alias("price"), (F.col("unit_cents") / 100).alias("unitPrice"),
        F.col("name").alias("rawContext"), F.lit(False).alias("suspect"), F.lit("medium").alias("confidence"),
        F.array().cast("array<string>").alias("suspectReasons"),
    )
    return X.final_clean(rows).select("page_id", "product", "suspect", "confidence", F.array_join("suspectReasons", ",").alias("reasons"))


@query("extract_bullet_pattern", LEAFLET_SQL + """
SELECT page_id, name AS product, 'zrnková' AS description, amount::VARCHAR || ' g' AS "packageSize",
 CAST(floor(unit_cents / 100 * (amount / 100) * 100 + 0.5) AS BIGINT) / 100 AS price, unit_cents / 100 AS "unitPrice" FROM rows""")
def extract_bullet_pattern(spark, sf):
    text = _t("@name", " • zrnková • ", "@amount", " g • 100 g = ", "#unit_cents", " Kč konec • ")
    pages = leaflets(spark, sf, dealt=False).select("page_id", text.alias("text"))
    offers = X.once_per_page(pages, lambda p, keep: X.extract_bullet_pattern(p, keep=keep), ["text"])
    return offers.select("page_id", "product", "description", "packageSize", "price", "unitPrice")


@query("extract_by_unit_window", LEAFLET_SQL + """
SELECT page_id, name AS product, amount::VARCHAR || ' g' AS "packageSize", pack_cents / 100 AS price, unit_cents / 100 AS "unitPrice"
FROM rows WHERE pack_cents <> unit_cents""")
def extract_by_unit_window(spark, sf):
    """All pages go in; those whose main price equals the unit price print no price of their own and give no offer."""
    text = _t("@name", " • ", "@amount", " g • 100 g = ", "#unit_cents", " Kč • ", "#pack_cents", " Kč")
    pages = leaflets(spark, sf, dealt=False).select("page_id", text.alias("text"))
    offers = X.once_per_page(pages, lambda p, keep: X.extract_by_unit_window(p, keep=keep), ["text"])
    return offers.select("page_id", "product", "packageSize", "price", "unitPrice")


@query("extract_bullet_neighbourhood", LEAFLET_SQL + """
SELECT page_id, 0 AS part, name AS product, amount::VARCHAR || ' g' AS "packageSize", pack_cents / 100 AS price FROM rows""")
def extract_bullet_neighbourhood(spark, sf):
    text = _t("@name", " • ", "@amount", " g • 25 • ", "#pack_cents", " Kč")
    offers = X.extract_bullet_neighbourhood(leaflets(spark, sf).select("page_id", text.alias("text")))
    return offers.select("page_id", "part", "product", "packageSize", "price")


@query("extract_line_windows", LEAFLET_SQL + f"""
SELECT page_id, name || ' ' || {amount_sql('pack_cents')} || ' Kč ' || amount::VARCHAR || ' g B C' AS "rawContext", pack_cents / 100 AS price, amount::VARCHAR || ' g' AS "packageSize" FROM rows
UNION ALL SELECT page_id, name || ' ' || {amount_sql('pack_cents')} || ' Kč ' || amount::VARCHAR || ' g B C D', pack_cents / 100, amount::VARCHAR || ' g' FROM rows
UNION ALL SELECT page_id, {amount_sql('pack_cents')} || ' Kč ' || amount::VARCHAR || ' g B C D', pack_cents / 100, amount::VARCHAR || ' g' FROM rows""")
def extract_line_windows(spark, sf):
    text = _t("@name", "\n", "#pack_cents", " Kč\n", "@amount", " g\nB\nC\nD")
    pages = leaflets(spark, sf, dealt=False).select("page_id", text.alias("text"))
    offers = X.once_per_page(pages, lambda p, keep: X.extract_line_windows(p, keep=keep), ["text"])
    return offers.select("page_id", "rawContext", "price", "packageSize")


@query("extract_price_marker_candidates", LEAFLET_SQL + """
SELECT page_id, name AS product, unit_cents / 100 AS price, 'action-lt' AS kind, amount::VARCHAR || ' g' AS "packageSize", '' AS category,
 4 + CASE WHEN length(name) BETWEEN 8 AND 70 THEN 2 ELSE 0 END AS score FROM rows
UNION ALL SELECT page_id, p_brand || ' PIVO', (unit_cents + 1000) / 100, 'za-price', amount::VARCHAR || ' g', 'pivo', 7 FROM rows""")
def extract_price_marker_candidates(spark, sf):
    filler = " " + "x" * 200 + " "
    text = F.concat(
        _t("strana 50% ", "@name", " ", "@amount", " g < ", "#unit_cents", " Kč" + filler + "30% ", "@p_brand", " PIVO ", "@amount", " g za "),
        amount_text(F.col("unit_cents") + 1000), F.lit(" Kč"),
    )
    pages = leaflets(spark, sf, dealt=False).select("page_id", "page_number", text.alias("text"))

    def candidates(distinct, keep):  # the page number is carried, not read
        return X.extract_price_marker_candidates(distinct.withColumn("page_number", F.lit(0)), keep=keep).drop("page_number")

    offers = X.once_per_page(pages, candidates, ["text"])
    return offers.select("page_id", "product", "price", "kind", "packageSize", "category", "score")


DICTIONARY = ["BLUE BOLT", "BLUE", "RED WIDGET", "SMALL RING", "RED", "NOWHERE TO BE FOUND"]


def _dictionary_pages(spark, sf):
    text = _t("úvod ", "@name", " ", "@amount", " g < ", "#unit_cents", " Kč konec")
    return leaflets(spark, sf, dealt=False).select("page_id", text.alias("text"))


START_SQL = """CASE WHEN starts_with(name, 'BLUE BOLT') THEN 'BLUE BOLT' WHEN starts_with(name, 'RED WIDGET') THEN 'RED WIDGET'
 WHEN starts_with(name, 'SMALL RING') THEN 'SMALL RING' WHEN starts_with(name, 'BLUE') THEN 'BLUE' WHEN starts_with(name, 'RED') THEN 'RED' END"""


@query("extract_dictionary_blocks", LEAFLET_SQL + f"""
SELECT page_id, 5 AS pos, {START_SQL} AS start, name AS product, amount::VARCHAR || ' g' AS "packageSize", unit_cents / 100 AS price
FROM rows WHERE {START_SQL} IS NOT NULL AND amount <> 100
UNION ALL SELECT page_id, 5, {START_SQL}, name, '100 g', unit_cents / 100 FROM rows WHERE {START_SQL} IS NOT NULL AND amount = 100""")
def extract_dictionary_blocks(spark, sf):
    offers = X.once_per_page(
        _dictionary_pages(spark, sf), lambda p, keep: X.dictionary_offers(X.extract_dictionary_blocks(p, DICTIONARY, keep=keep)), ["text"]
    )
    return offers.select("page_id", "pos", "start", "product", "packageSize", "price")


DICTIONARY_PAGES_SQL = """
WITH p AS (SELECT p_partkey AS k, '#' || p_name AS name, p_partkey % 7 = 0 AS bare FROM part),
pages AS (SELECT k, name, bare, 'Úvod ' || upper(name) || CASE WHEN bare THEN '' ELSE ' NR' || k::VARCHAR || 'X' END AS first,
 upper(name) || ' NR' || (k * 3)::VARCHAR || 'X' AS second FROM p),
has AS (SELECT DISTINCT name || ' nr' || k::VARCHAR || 'x' AS long FROM p)"""


@query("dictionary_table_blocks", DICTIONARY_PAGES_SQL + """
SELECT k AS page_id, 5 AS pos, CASE WHEN bare THEN name ELSE name || ' nr' || k::VARCHAR || 'x' END AS start, substr(first, 6) || ' 100 g < 12,90 Kč' AS block FROM pages
UNION ALL SELECT k, CAST(length(first) + 18 AS INTEGER), coalesce(long, name), second || ' konec' FROM pages LEFT JOIN has ON long = name || ' nr' || (k * 3)::VARCHAR || 'x'""")
def dictionary_table_blocks(spark, sf):
    """X10 with a table: all part names, bare and with a number of their own, so that the longer start must win."""
    parts = dealt_parts(spark, sf).select("p_partkey", F.concat(F.lit("#"), "p_name").alias("name"))
    number = F.col("p_partkey").cast("string")
    names = parts.select(F.explode(F.array(F.col("name"), F.concat("name", F.lit(" nr"), number, F.lit("x")))).alias("start"))
    own = F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" NR"), number, F.lit("X")))
    other = F.concat(F.lit(" NR"), (F.col("p_partkey") * 3).cast("string"), F.lit("X"))
    text = F.concat(F.lit("Úvod "), F.upper("name"), own, F.lit(" 100 g < 12,90 Kč "), F.upper("name"), other, F.lit(" konec"))
    return X.extract_dictionary_blocks(parts.select(F.col("p_partkey").alias("page_id"), text.alias("text")), names)


@query("missing_starts", "SELECT 'NOWHERE TO BE FOUND' AS start WHERE (SELECT count(*) FROM part) > 0")
def missing_starts(spark, sf):
    # Which starts occur depends on the distinct pages alone.
    pages = _dictionary_pages(spark, sf).select("text").distinct()
    return X.missing_starts(X.extract_dictionary_blocks(pages, DICTIONARY, keep=()), DICTIONARY)


@query("pair_by_ordinal", LEAFLET_SQL + """
SELECT page_id, 0 AS ordinal, name AS product, unit_cents / 100 AS price, true AS "countMismatch" FROM rows
UNION ALL SELECT page_id, 1, p_brand, pack_cents / 100, true FROM rows UNION ALL SELECT page_id, 2, p_type, NULL, true FROM rows""")
def pair_by_ordinal(spark, sf):
    text = _t("nabídka ", "#unit_cents", " < 5,90 nejnižší cena 4,90 ", "#pack_cents", " 7,90/ 8,90 %")
    pages = leaflets(spark, sf).withColumn("text", text)
    return X.pair_by_ordinal(pages, X.current_prices("text"), F.array("name", "p_brand", "p_type"))


@query("pair_tables_by_ordinal", """
WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ordinal FROM events
 WHERE event_type IN ('view', 'purchase'))
SELECT v.user_id, CAST(v.ordinal AS INTEGER) AS ordinal, v.value AS viewed, p.value AS price FROM e v LEFT JOIN e p
 ON v.user_id = p.user_id AND v.ordinal = p.ordinal AND p.event_type = 'purchase' WHERE v.event_type = 'view'""")
def pair_tables_by_ordinal(spark, sf):
    from pricewren.operators.lines import with_ordinal

    events = table(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase"))
    ranked = with_ordinal(events, ["user_id", "event_type"], "ts", "event_id").withColumn("ordinal", F.col("ordinal").cast("int"))
    products = ranked.filter("event_type = 'view'").select("user_id", "ordinal", F.col("value").alias("viewed"))
    prices = ranked.filter("event_type = 'purchase'").select("user_id", "ordinal", F.col("value").alias("price"))
    return X.pair_tables_by_ordinal(prices, products, ["user_id"])


def _upper_pages(spark, sf):
    text = _t("#pack_cents", "\n", "@name", " ZRNKOVÁ\nrůzné druhy\n", "@amount", " g\n< 5,90 Kč\nxxx\nyyy")
    return leaflets(spark, sf, dealt=False).select("page_id", "page_number", text.alias("text"))


@query("extract_uppercase_lines", LEAFLET_SQL + """
SELECT page_id, name || ' ZRNKOVÁ různé druhy ' || amount::VARCHAR || ' g' AS product, amount::VARCHAR || ' g' AS "packageSize", pack_cents / 100 AS price,
 5.9::DOUBLE AS "lowest30dPrice", CASE WHEN page_number <= 2 THEN 'ovoce, zelenina a maso' ELSE 'chlazené, mléčné a pečivo' END AS category, 'high' AS confidence
FROM rows""")
def extract_uppercase_lines(spark, sf):
    offers = X.once_per_page(_upper_pages(spark, sf), lambda p, keep: X.extract_uppercase_lines(p, keep=keep), ["page_number", "text"])
    return offers.select("page_id", "product", "packageSize", "price", "lowest30dPrice", "category", "confidence")


@query("page_product_lines", LEAFLET_SQL + f"""
SELECT page_id, 0 AS ordinal, name || ' ZRNKOVÁ' AS product, {amount_sql('pack_cents')} || ' | ' || name || ' ZRNKOVÁ | různé druhy | ' || amount::VARCHAR || ' g | < 5,90 Kč' AS context FROM rows""")
def page_product_lines(spark, sf):
    pages = _upper_pages(spark, sf).withColumn("text", F.regexp_replace("text", r"(?m)^\d+ g$", "• $0"))
    lines = X.once_per_page(pages, lambda p, keep: X.page_product_lines(p, keep=keep), ["text"])
    return lines.filter(~F.col("product").rlike(r"^[\d<]")).select("page_id", F.lit(0).alias("ordinal"), "product", "context")


@query("extract_product_tiles", LEAFLET_SQL + f"""
SELECT page_id, 0 AS tile, page_number::VARCHAR AS "klNr", p_name || ' & ' || p_brand AS product, amount::VARCHAR || ' g' AS "packageSize", pack_cents / 100 AS price,
 (pack_cents + 1000) / 100 AS "oldPrice", unit_cents / 100 AS "unitPrice", 'Kč/100 g' AS unit, p_type AS category, '-25%' AS "priceType",
 'https://shop.example/i/' || p_type || '.jpg' AS "imageUrl" FROM rows""")
def extract_product_tiles(spark, sf):
    html = F.concat(
        _t('<div><a class="x k-product-tile" href="/d?kloffer-articleID=', "@page_number", "&amp;kloffer-category=0042_", "@p_type",
           '"><img class="k-product-tile__main-image" alt="', "@p_name", " &amp; ", "@p_brand", '" src="/i/', "@p_type",
           '.jpg?w=1"><div class="k-price-tag__discount">-25%</div><div class="k-price-tag__price">', "#pack_cents",
           '</div><span class="k-price-tag__old-price-line-through">'),
        amount_text(F.col("pack_cents") + 1000),
        _t('</span><div class="k-product-tile__unit-price">', "@amount", ' g</div><div class="k-product-tile__base-price">(=100 g ', "#unit_cents",
           ")</div></a><a class='other'>no</a></div>"),
    )
    pages = leaflets(spark, sf, dealt=False).select("page_id", F.lit("https://shop.example/list.html").alias("url"), html.alias("html"))
    return X.once_per_page(pages, lambda p, keep: X.extract_product_tiles(p, keep=keep), ["url", "html"]).drop("sourceUrl")


@query("tile_diagnostics", """
SELECT p_partkey AS id, CAST(2 AS INTEGER) AS article_ids, CAST(1 AS INTEGER) AS distinct_article_ids, CAST(2 AS INTEGER) AS anchor_tiles,
 CAST(2 AS INTEGER) AS price_tags FROM part""")
def tile_diagnostics(spark, sf):
    tile = F.concat(F.lit('<a class="k-product-tile" href="?kloffer-articleID='), F.col("p_partkey").cast("string"), F.lit('"><div class="k-price-tag__price">1</div></a>'))
    found = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), H.tile_diagnostics(F.concat(tile, tile)).alias("d"))
    return found.select("id", "d.article_ids", "d.distinct_article_ids", "d.anchor_tiles", "d.price_tags")


@query("map_json_offers", """
SELECT p_partkey AS seq, p_name AS product, p_partkey::VARCHAR AS "klNr", p_type AS category, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS price,
 CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS "unitPrice" FROM part""")
def map_json_offers(spark, sf):
    item = F.to_json(F.struct(
        F.lit("").alias("productName"), F.col("p_name").alias("title"), F.col("p_partkey").alias("articleId"), F.col("p_type").alias("mainCategory"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("currentPrice"),
    ))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), item.alias("item"))
    return X.map_json_offers(items).select("seq", "product", "klNr", "category", "price", "unitPrice")


@query("extract_known_products", LEAFLET_SQL + """
SELECT page_id, p_name AS product, pack_cents / 100 AS price FROM rows WHERE amount <> 100
 AND len(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4)) > 0""")
def extract_known_products(spark, sf):
    rows = leaflets(spark, sf)
    pages = rows.select("page_id", _t("strana ", "@name", " ", "#pack_cents", " Kč").alias("text"))
    wrong = F.when(F.col("amount") == 100, F.col("pack_cents") / 100 + 3).otherwise(F.col("pack_cents") / 100)
    facts = rows.select("page_id", F.col("p_name").alias("product"), wrong.alias("price"))
    return X.extract_known_products(pages, facts, page="page_id").select("page_id", "product", "price")


@query("name_predicates", LEAFLET_SQL + """
SELECT page_id, length(name) < 4 OR length(name) > 95 AS bad_segment, false AS bad_heading, true AS good_bullet, false AS bad_pattern FROM rows""")
def name_predicates(spark, sf):
    return leaflets(spark, sf).select(
        "page_id", N.bad_segment_name(F.col("name")).alias("bad_segment"), N.bad_heading_name(F.col("name")).alias("bad_heading"),
        N.good_bullet_name(F.initcap("p_name")).alias("good_bullet"), N.bad_pattern_name(F.col("name")).alias("bad_pattern"),
    )


@query("bullet_description", LEAFLET_SQL + "SELECT page_id, p_brand || '; ' || p_type AS description FROM rows")
def bullet_description(spark, sf):
    bullets = F.array(F.lit("• vybrané druhy"), F.concat(F.lit("• "), "p_brand"), _t("• ", "@amount", " g"), F.concat(F.lit("•"), "p_type"), F.lit("• třetí"))
    return leaflets(spark, sf).select("page_id", N.bullet_description(bullets).alias("description"))


@query("split_pages", """
SELECT p_partkey AS id, CAST(n AS INTEGER) AS page_number, CASE n WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE p_type END AS text
FROM part, (SELECT unnest([1, 2, 3]) AS n)""")
def split_pages(spark, sf):
    from pricewren.sources.readers import split_pages as split

    text = F.concat_ws("\f", F.concat(F.lit(" "), "p_name", F.lit("  ")), "p_brand", "p_type")
    return split(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), keep=("id",))


@query("discount_and_old_price", LEAFLET_SQL + """
SELECT page_id, round(1 - (pack_cents / 100) / ((pack_cents + 1000) / 100), 9) AS share FROM rows""")
def discount_and_old_price(spark, sf):
    rows = leaflets(spark, sf).select("page_id", M.discount_share(F.col("pack_cents") / 100, (F.col("pack_cents") + 1000) / 100).alias("s"))
    return rows.select("page_id", F.round("s", 9).alias("share"))
