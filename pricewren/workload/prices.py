"""Queries over lineitem prices: parsing, rounding, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.functions import money as M, package as K, quality as Q
from pricewren.operators import extract as X, ordered, reconcile as R
from pricewren.workload.registry import query
from pricewren.workload.views import amount_sql, amount_text, priced_lines, table, with_prices



def _price(column="cents"):
    return amount_text(F.col(column))


def _rows(name, sql):
    """Register ``build(rows) -> columns`` over the priced lineitem rows."""

    def add(build):
        @query(name, with_prices(sql))
        def run(spark, sf):
            return build(priced_lines(spark, sf))

        return run

    return add


@_rows("parse_money", "SELECT id, cents / 100 AS price, CAST(cents // 100 AS DOUBLE) AS whole FROM rows")
def parse_money(rows):
    grouped = F.regexp_replace(_price(), r"^(\d+)(\d{3},)", "$1 $2")
    whole = F.concat(F.floor(F.col("cents") / 100).cast("string"), F.lit(",-"))
    return rows.select("id", M.parse_money(F.concat(grouped, F.lit(" Kč"))).alias("price"), M.parse_money(whole).alias("whole"))


@_rows("repair_ocr_money", "SELECT id, (1000 + cents % 9000) / 100 AS price FROM rows")
def repair_ocr_money(rows):
    return rows.select("id", M.repair_ocr_money(F.concat(F.lit("20"), amount_text(F.col("cents") % 9000 + 1000))).alias("price"))


@_rows("to_number", "SELECT id, CASE WHEN mix % 3 = 0 THEN NULL ELSE cents / 100 END AS price FROM rows")
def to_number(rows):
    text = F.when(F.col("mix") % 3 == 0, F.lit("NaN")).otherwise((F.col("cents") / 100).cast("string"))
    return rows.select("id", M.to_number(text).alias("price"))


@_rows("money_text", f"""
SELECT id, replace(regexp_replace(reverse(regexp_replace(reverse((cents // 100)::VARCHAR), '(\\d{{3}})', '\\1_', 'g')), '^_', ''), '_', chr(160))
 || CASE WHEN cents % 100 = 0 THEN '' ELSE ',' || lpad((cents % 100)::VARCHAR, 2, '0') END || ' Kč' AS text FROM rows""")
def money_text(rows):
    return rows.select("id", M.money_text(F.col("cents") / 100).alias("text"))


@_rows("extract_prices", f"""
SELECT id, {amount_sql('unit_cents')} || ' Kč|' || (cents % 900 + 100)::VARCHAR || ',-|' || (pack + 7)::VARCHAR || ' Kč' AS prices FROM rows""")
def extract_prices(rows):
    text = F.concat(
        F.lit("cena "), _price("unit_cents"), F.lit(" Kč, nebo "), (F.col("cents") % 900 + 100).cast("string"), F.lit(",- a opět "),
        _price("unit_cents"), F.lit(" Kč; "), (F.col("pack") + 7).cast("string"), F.lit(" Kč"),
    )
    return rows.select("id", F.array_join(M.extract_prices(text), "|").alias("prices"))


@_rows("price_markers", """
SELECT id, 5 AS pos, unit_cents / 100 AS price, 'action-lt' AS kind FROM rows UNION ALL
SELECT id, CAST(5 + 2 + length((unit_cents // 100)::VARCHAR) + 6 + 3 AS INTEGER), (unit_cents + 100) / 100, 'za-price' FROM rows""")
def price_markers(rows):
    text = F.concat(F.lit("zboží< "), _price("unit_cents"), F.lit(" Kč B "), F.lit("za "), amount_text(F.col("unit_cents") + 100), F.lit(" Kč"))
    return rows.select("id", F.inline(M.price_markers(text)))


@_rows("classify_price", """
SELECT id, unit_cents / 100 AS price, true AS "isLowest30", false AS "isUnitPrice", false AS "isDeposit" FROM rows UNION ALL
SELECT id, (unit_cents + 1000) / 100, false, false, false FROM rows UNION ALL
SELECT id, (unit_cents + 5) / 100, false, true, false FROM rows UNION ALL SELECT id, 3.0, false, false, true FROM rows""")
def classify_price(rows):
    filler = " " + "x" * 60 + " "
    text = F.concat(
        F.lit("A < "), _price("unit_cents"), F.lit(" Kč" + filler), amount_text(F.col("unit_cents") + 1000), F.lit(filler + "100 g "),
        amount_text(F.col("unit_cents") + 5), F.lit(" Kč" + filler + "záloha 3,00 Kč"),
    )
    pages = rows.select("id", text.alias("text"))
    flat = X.once_per_page(pages, lambda p, keep: p.select(*keep, F.inline(M.classify_price("text"))), ["text"], keep=("id",))
    return flat.select("id", "price", "isLowest30", "isUnitPrice", "isDeposit")


@_rows("pick_current_price", """
SELECT id, (unit_cents + 1000) / 100 AS current_price, unit_cents / 100 AS with_lowest FROM rows""")
def pick_current_price(rows):
    text = F.concat(F.lit("PROSECCO < "), _price("unit_cents"), F.lit(" Kč "), amount_text(F.col("unit_cents") + 1000), F.lit(" konec"))
    prices = M.classify_price(text)
    return rows.select(
        "id", M.pick_current_price(prices).alias("current_price"), M.pick_current_price(prices, allow_lowest30=True).alias("with_lowest")
    )


@_rows("pick_card_price", """
SELECT id, CASE WHEN mix % 2 = 0 THEN unit_cents / 100 ELSE (unit_cents + 500) / 100 END AS price,
 CASE WHEN mix % 2 = 0 THEN 's kartou' ELSE 'akční cena' END AS "priceType" FROM rows""")
def pick_card_price(rows):
    card = F.when(F.col("mix") % 2 == 0, F.lit("s PENNY kartou")).otherwise(F.lit("bez karty"))
    lines = F.array(F.concat(amount_text(F.col("unit_cents") + 500), F.lit(" Kč")), card, F.concat(_price("unit_cents"), F.lit(" Kč 99,90 Kč")))
    return rows.withColumn("p", M.pick_card_price(lines)).select("id", "p.price", "p.priceType")


@_rows("parse_unit_price", f"""
SELECT id, unit_cents / 100 AS "unitPrice", CASE mix % 3 WHEN 0 THEN 'Kč/100 g' WHEN 1 THEN 'Kč/1 kg' ELSE 'Kč/0,5 l' END AS unit FROM rows""")
def parse_unit_price(rows):
    base = F.when(F.col("mix") % 3 == 0, F.lit("100 g = ")).when(F.col("mix") % 3 == 1, F.lit("1  kg od ")).otherwise(F.lit("0,5 l "))
    text = F.concat(F.lit("• zboží • "), base, _price("unit_cents"), F.lit(" Kč • konec"))
    return rows.withColumn("u", M.parse_unit_price(text)).select("id", "u.unitPrice", "u.unit")


@_rows("parse_unit_multi", """
SELECT id, '100 g' AS "unitBase", unit_cents / 100 AS first_price, (unit_cents + 250) / 100 AS second_price FROM rows""")
def parse_unit_multi(rows):
    text = F.concat(F.lit("100  g "), _price("unit_cents"), F.lit("/"), amount_text(F.col("unit_cents") + 250), F.lit(" Kč"))
    return rows.withColumn("u", M.parse_unit_multi(text)).select(
        "id", "u.unitBase", F.get("u.unitPrices", F.lit(0)).alias("first_price"), F.get("u.unitPrices", F.lit(1)).alias("second_price")
    )


def _package():
    size = F.col("pack").cast("string")
    return (
        F.when(F.col("mix") % 4 == 0, F.concat(size, F.lit(" g")))
        .when(F.col("mix") % 4 == 1, F.concat(F.lit("6 x "), size, F.lit(" ml")))
        .when(F.col("mix") % 4 == 2, F.concat(size, F.lit("–"), (F.col("pack") + 20).cast("string"), F.lit(" g")))
        .otherwise(F.concat(F.lit("0,"), F.lpad((F.col("pack") % 100).cast("string"), 2, "0"), F.lit(" l")))
    )


PACKAGE_SQL = """CASE mix % 4 WHEN 0 THEN pack::VARCHAR || ' g' WHEN 1 THEN '6 x ' || pack::VARCHAR || ' ml'
 WHEN 2 THEN pack::VARCHAR || '–' || (pack + 20)::VARCHAR || ' g' ELSE '0,' || lpad((pack % 100)::VARCHAR, 2, '0') || ' l' END"""


@_rows("parse_package", """
SELECT id, CAST(CASE mix % 4 WHEN 1 THEN pack * 6 WHEN 3 THEN CAST(('0.' || lpad((pack % 100)::VARCHAR, 2, '0')) AS DOUBLE) ELSE pack END AS DOUBLE) AS amount,
 CASE mix % 4 WHEN 1 THEN 'ml' WHEN 3 THEN 'l' ELSE 'g' END AS unit FROM rows UNION ALL
SELECT id, CAST(pack + 20 AS DOUBLE), 'g' FROM rows WHERE mix % 4 = 2""")
def parse_package(rows):
    return rows.select("id", F.inline(K.parse_package(_package())))


@_rows("extract_package", f"SELECT id, {PACKAGE_SQL} AS package FROM rows")
def extract_package(rows):
    return rows.select("id", K.extract_package(F.concat(F.lit("zboží "), _package(), F.lit(" navíc 5 ks"))).alias("package"))


@_rows("last_package", f"SELECT id, {PACKAGE_SQL} AS package, 250 || ' ml' AS preferred FROM rows")
def last_package(rows):
    return rows.select(
        "id", K.last_package(F.concat(F.lit("ZBOŽÍ 3 ks SÝR "), _package(), F.lit(" "))).alias("package"),
        K.preferred_package(F.concat(F.lit("3 role 250 ml "), _package())).alias("preferred"),
    )


@_rows("is_package", "SELECT id, mix % 4 IN (0, 3) AS package FROM rows")
def is_package(rows):
    return rows.select("id", K.is_package(_package()).alias("package"))


BASE_SQL = "CASE mix % 4 WHEN 0 THEN pack * 1.0 WHEN 1 THEN pack * 6.0 WHEN 2 THEN pack + 20.0 ELSE (pack % 100) * 10.0 END"


@_rows("base_amount", f"SELECT id, CAST({BASE_SQL} AS DOUBLE) AS amount FROM rows")
def base_amount(rows):
    return rows.select("id", F.round(K.base_amount(_package()), 6).alias("amount"))


RETAIL_SQL = """CASE WHEN c IS NULL THEN NULL WHEN c % 100 BETWEEN 91 AND 94 THEN c // 100 + 0.9 WHEN c % 100 BETWEEN 96 AND 99 THEN CAST(c // 100 + 1 AS DOUBLE)
 WHEN c % 100 BETWEEN 1 AND 4 THEN CAST(c // 100 AS DOUBLE) ELSE c / 100 END"""


@_rows("round_retail", f"SELECT id, CAST({RETAIL_SQL} AS DOUBLE) AS price FROM (SELECT id, unit_cents AS c FROM rows)")
def round_retail(rows):
    return rows.select("id", M.round_retail(F.col("unit_cents") / 100).alias("price"))


@_rows("pack_price", f"""
SELECT id, CAST({RETAIL_SQL} AS DOUBLE) AS price FROM
 (SELECT id, CAST(floor(unit_cents / 100 * (pack / 100) * 100 + 0.5) AS BIGINT) AS c FROM rows)""")
def pack_price(rows):
    package = F.concat(F.col("pack").cast("string"), F.lit(" g"))
    return rows.select("id", K.pack_price(F.col("unit_cents") / 100, F.lit("Kč/100 g"), package).alias("price"))


@_rows("snap_tenth", """
SELECT id, CASE WHEN abs(p - floor(p * 10 + 0.5) / 10) <= 0.025 THEN floor(p * 10 + 0.5) / 10 ELSE floor(p * 100 + 0.5) / 100 END AS price
FROM (SELECT id, unit_cents / 100 AS p FROM rows)""")
def snap_tenth(rows):
    return rows.select("id", M.snap_tenth(F.col("unit_cents") / 100).alias("price"))


@_rows("parse_validity", """
SELECT id, DATE '2026-05-01' + CAST(pack % 28 AS INTEGER) AS "validFrom", DATE '2026-06-01' + CAST(mix % 28 AS INTEGER) AS "validTo" FROM rows""")
def parse_validity(rows):
    text = F.concat(
        F.lit("body do 2. 6. 2026, platí od středy "), (F.col("pack") % 28 + 1).cast("string"), F.lit(". 5. 2026 do úterý "),
        (F.col("mix") % 28 + 1).cast("string"), F.lit(". 6.  2026"),
    )
    return rows.withColumn("v", M.parse_validity(text)).select("id", "v.validFrom", "v.validTo")


@_rows("lead_prices", """
SELECT id, CAST(2 AS INTEGER) AS n, unit_cents / 100 AS first_price, (unit_cents + 900) / 100 AS second_price FROM rows""")
def lead_prices(rows):
    text = F.concat(_price("unit_cents"), F.lit(" 279,90/ 25% "), amount_text(F.col("unit_cents") + 900), F.lit(" 39,90 / 10 %"))
    prices = rows.withColumn("p", M.lead_prices(text))
    return prices.select("id", F.size("p").alias("n"), F.get("p", F.lit(0)).alias("first_price"), F.get("p", F.lit(1)).alias("second_price"))


@_rows("action_price_plausible", "SELECT id, cents % 100 IN (0, 90, 99) AS plausible FROM rows")
def action_price_plausible(rows):
    return rows.select("id", M.action_price_plausible(F.col("cents") / 100).alias("plausible"))


@_rows("discount_share", "SELECT id, 1 - (unit_cents / 100) / ((unit_cents + 500) / 100) AS share FROM rows")
def discount_share(rows):
    return rows.select("id", M.discount_share(F.col("unit_cents") / 100, (F.col("unit_cents") + 500) / 100).alias("share"))


# --- reconciliation ----------------------------------------------------------
SNAP_SQL = "CASE WHEN abs({0} - floor({0} * 10 + 0.5) / 10) <= 0.025 THEN floor({0} * 10 + 0.5) / 10 ELSE floor({0} * 100 + 0.5) / 100 END"
CANDIDATES_SQL = f"""
, u AS (SELECT id, unit_cents / 100 AS up, 0 AS adjusted, pack, cents FROM rows UNION ALL
 SELECT id, {SNAP_SQL.format('(unit_cents / 100 / 10)')}, 1, pack, cents FROM rows WHERE unit_cents >= 1000),
v AS (SELECT id, up, adjusted, cents, unnest([pack, pack + 20]) AS amount FROM u),
c AS (SELECT *, {SNAP_SQL.format('(up * (amount / 100))')} AS price FROM v),
r AS (SELECT *, unnest([1.5 + cents % 40, 9.9 + cents % 90, 25.9 + cents % 130]) AS lead FROM c),
n AS (SELECT id, up, adjusted, amount, price, min(abs(price - lead)) AS diff, arg_min(lead, (abs(price - lead), lead)) AS nearest FROM r GROUP BY ALL)"""


def _references():
    cents = F.col("cents")
    return F.array(cents % 40 + 1.5, cents % 90 + 9.9, cents % 130 + 25.9)


def _candidates():
    package = F.concat(F.col("pack").cast("string"), F.lit("/"), (F.col("pack") + 20).cast("string"), F.lit(" g"))
    return K.price_candidates(package, F.lit("100 g"), F.array(F.col("unit_cents") / 100), _references())


@_rows("price_candidates", CANDIDATES_SQL + """
SELECT id, adjusted, price, round(diff, 6) AS diff FROM n""")
def price_candidates(rows):
    # A generator over a named column gets a filter on it, which would build the candidates twice more.
    return rows.select("id", F.inline(_candidates())).select("id", "adjusted", "price", F.round("diff", 6).alias("diff"))


@_rows("best_candidate", CANDIDATES_SQL + """
SELECT id, round(diff, 6) AS diff, CASE WHEN diff <= 0.15 THEN 'near' ELSE 'far' END AS kind FROM (SELECT id, min(diff) AS diff FROM n GROUP BY 1)""")
def best_candidate(rows):
    best = rows.withColumn("b", K.best_candidate(_candidates()))
    return best.select("id", F.round("b.diff", 6).alias("diff"), F.when(F.col("b.diff") <= 0.15, "near").otherwise("far").alias("kind"))


@_rows("nearest_reference_price", """
SELECT id, round(least(abs(p - a), abs(p - b), abs(p - c)), 6) AS diff FROM
 (SELECT id, unit_cents / 100 AS p, 1.5 + cents % 40 AS a, 9.9 + cents % 90 AS b, 25.9 + cents % 130 AS c FROM rows)""")
def nearest_reference_price(rows):
    near = M.nearest_price(F.col("unit_cents") / 100, _references())
    return rows.select("id", F.round(near["diff"], 6).alias("diff"))


@_rows("choose_price", CANDIDATES_SQL + """
, b AS (SELECT id, arg_min({'p': price, 'd': diff, 'a': adjusted, 'n': nearest}, (diff, adjusted, price)) AS s FROM n GROUP BY id)
SELECT rows.id, CASE WHEN mix % 5 >= 2 THEN CASE WHEN s.d <= 0.15 THEN s.n ELSE s.p END WHEN mix % 5 = 0 THEN unit_cents / 100 END AS price,
 CASE WHEN mix % 5 >= 2 THEN CASE WHEN s.a = 1 THEN 'computed-adjusted-unit-price' ELSE 'computed' END WHEN mix % 5 = 0 THEN 'lead' ELSE 'missing' END AS source
FROM b JOIN rows ON b.id = rows.id""")
def choose_price(rows):
    # Every fifth row has a lead price only, another fifth has neither.
    best = rows.withColumn("b", F.when(F.col("mix") % 5 >= 2, K.best_candidate(_candidates())))
    chosen = best.withColumn("x", R.choose_price(F.col("b"), F.when(F.col("mix") % 5 == 0, F.col("unit_cents") / 100)))
    return chosen.select("id", "x.price", "x.source")


@_rows("explicit_else_computed", f"""
SELECT id, CASE WHEN mix % 2 = 0 THEN CAST((SELECT {RETAIL_SQL} FROM (SELECT unit_cents + 700 AS c)) AS DOUBLE)
 ELSE CAST((SELECT {RETAIL_SQL} FROM (SELECT CAST(floor(unit_cents / 100 * (pack / 100) * 100 + 0.5) AS BIGINT) AS c)) AS DOUBLE) END AS price FROM rows""")
def explicit_else_computed(rows):
    explicit = F.when(F.col("mix") % 2 == 0, F.concat(F.lit(" • "), amount_text(F.col("unit_cents") + 700), F.lit(" Kč"))).otherwise(F.lit(""))
    bullets = F.concat(F.lit("• 100 g = "), _price("unit_cents"), F.lit(" Kč"), explicit)
    package = F.concat(F.col("pack").cast("string"), F.lit(" g"))
    return rows.select("id", X.explicit_else_computed(bullets, F.col("unit_cents") / 100, F.lit("Kč/100 g"), package).alias("price"))


@_rows("computed_with_close_explicit", """
SELECT id, CASE WHEN abs(e - p) / greatest(p, 1.0) < 0.08 THEN e ELSE p END AS price FROM
 (SELECT id, unit_cents / 100 AS p, (unit_cents + pack) / 100 AS e FROM rows)""")
def computed_with_close_explicit(rows):
    after = F.concat(F.lit(" nebo "), amount_text(F.col("unit_cents") + F.col("pack")), F.lit(" Kč"))
    return rows.select("id", X.computed_with_close_explicit(after, F.col("unit_cents") / 100).alias("price"))


SUSPECT_SQL = """list_filter([
 CASE WHEN p > 999 THEN 'very-high-price' END,
 CASE WHEN p >= 80 AND d > 20 THEN 'liquid-price-far-from-leaflet-price' END,
 CASE WHEN d > 20 THEN 'computed-price-far-from-nearest-lead-price' END,
 CASE WHEN p >= 80 AND d > 15 THEN 'small-package-high-price' END], lambda x: x IS NOT NULL)"""


@_rows("suspect_price", f"""
SELECT id, array_to_string({SUSPECT_SQL}, ',') AS reasons FROM (SELECT id, cents / 100 AS p, CAST(pack % 30 AS DOUBLE) AS d FROM rows)""")
def suspect_price(rows):
    found = Q.suspect_price(F.col("cents") / 100, F.lit("100 ml"), F.lit("500 ml"), (F.col("pack") % 30).cast("double"))
    return rows.select("id", F.array_join(found, ",").alias("reasons"))


@_rows("price_safety", f"""
SELECT id, CASE WHEN mix % 2 = 1 AND d <= 0.15 THEN '' ELSE array_to_string({SUSPECT_SQL}, ',') END AS reasons
FROM (SELECT id, mix, cents / 100 AS p, CAST(pack % 30 AS DOUBLE) AS d FROM rows)""")
def price_safety(rows):
    diff = (F.col("pack") % 30).cast("double")
    found = Q.suspect_price(F.col("cents") / 100, F.lit("100 ml"), F.lit("500 ml"), diff)
    return rows.select("id", F.array_join(Q.price_safety(found, F.col("mix") % 2, diff), ",").alias("reasons"))


@_rows("price_conflict", """
SELECT id, NOT (abs(e - p) <= 0.11) AND e >= 5 AND abs(e - p) >= 0.5 AND ((unit_cents % 100) IN (0, 20, 21, 22, 23, 24, 25, 91, 92, 93, 94)
 OR (abs(e - p) BETWEEN 0.5 AND 1.5 AND p = floor(p))) AS conflict
FROM (SELECT id, unit_cents, unit_cents / 100 AS p, (unit_cents + pack - 10) / 100 AS e FROM rows)""")
def price_conflict(rows):
    context = F.concat(F.lit("Zboží "), amount_text(F.col("unit_cents") + F.col("pack") - 10), F.lit(" Kč konec"))
    return rows.select("id", M.price_conflict(F.col("unit_cents") / 100, context, F.lit(None).cast("double")).alias("conflict"))


@_rows("package_conflict", "SELECT id, mix % 2 = 0 AS conflict FROM rows")
def package_conflict(rows):
    size = F.col("pack").cast("string")
    product = F.concat(F.lit("Šampon "), F.when(F.col("mix") % 2 == 0, (F.col("pack") + 1).cast("string")).otherwise(size), F.lit(" ml"))
    return rows.select("id", K.package_conflict(product, F.concat(size, F.lit("  ml"))).alias("conflict"))


@_rows("segment_confidence", """
SELECT id, CASE WHEN mix % 5 = 0 THEN 'medium' WHEN pack % 30 <= 0.15 THEN 'high' ELSE 'medium' END AS confidence FROM rows""")
def segment_confidence(rows):
    return rows.select(
        "id", Q.segment_confidence(F.col("mix") % 5 == 0, F.col("cents") / 100, F.lit("KÁVA ALFA"), (F.col("pack") % 30).cast("double")).alias("confidence")
    )


@query("nearest_reference_join", """
WITH f AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_linenumber AS page, floor(l_extendedprice / l_quantity + 0.5) AS price FROM lineitem),
r AS (SELECT p_size % 8 AS page, p_partkey AS part, p_name AS name, floor(p_retailprice + 0.5) AS price FROM part WHERE p_size % 8 <> 5),
n AS (SELECT f.*, r.part, r.name, r.price AS near, abs(f.price - r.price) AS diff,
  row_number() OVER (PARTITION BY id ORDER BY abs(f.price - r.price), r.part) AS k
 FROM f LEFT JOIN r ON f.page = r.page)
SELECT l_orderkey, l_linenumber, price, near AS nearest_reference, part AS nearest_part, name AS nearest_name, diff FROM n WHERE k = 1""")
def nearest_reference_join(spark, sf):
    """R2 against a table: unit prices of all line items and the closest retail price of their page; page 5 has none."""
    items = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_linenumber as page", "floor(l_extendedprice / l_quantity + 0.5) * 1D as price")
    parts = table(spark, sf, "part").filter("p_size % 8 <> 5").selectExpr(
        "p_size % 8 as page", "p_partkey as part", "p_name as name", "floor(p_retailprice + 0.5) * 1D as reference"
    )
    found = ordered.nearest_join(items, parts, ["page"], value="price", reference="reference", order="part", keep=["name"])
    return found.select("l_orderkey", "l_linenumber", "price", "nearest_reference", "nearest_part", "nearest_name", "diff")
