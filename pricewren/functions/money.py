"""Price and date columns (rows P1-P10, P16-P21, R2, R9 of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricewren import rules
from pricewren.functions.html import match_positions
from pricewren.functions.patterns import AMOUNT, EDGE_L, EDGE_R, LOOSE_AMOUNT, SPACES, opening
from pricewren.functions.text import as_normalized, col, let, squeeze, text_of

NBSP = "\u00a0"
# The digit is looked for first: it costs less at every place than the look-behind.
PRICE_LITERAL = (
    rf"(?iu)(?=\d)(?:{EDGE_L}\d{{1,4}}(?:\s?\d{{3}})?[,.]\d{{2}}\s*Kč|{EDGE_L}\d{{1,4}},-"
    rf"|{EDGE_L}\d{{1,4}}[,.]\d{{2}}{EDGE_R}|{EDGE_L}\d{{2,4}}\s*Kč{EDGE_R})"
)
BARE_PRICE = rf"(?iu)(?=\d){EDGE_L}\d{{1,4}}[,.]\d{{2}}{EDGE_R}"


def parse_money(c: Column | str) -> Column:
    """``"1 299,90 Kč"`` -> 1299.9, ``"12,-"`` -> 12.0, no digit -> null."""
    def whole(text: Column) -> Column:
        value = F.regexp_replace(text, rf"(?iu){SPACES}|Kč", "")
        return F.regexp_replace(value, "^([^,]*),-", "$1,00")

    def pointed(value: Column) -> Column:
        at = F.instr(value, F.lit(","))
        rest = F.replace(F.substring(value, at + 1, F.length(value)), F.lit(","), F.lit(""))
        return F.when(at == 0, value).otherwise(F.concat(F.substring(value, F.lit(1), at - 1), F.lit("."), rest))

    # Blanks and currency only matter where they part a comma from its dash.
    digits = let(text_of(c), lambda text: F.regexp_replace(
        F.when(F.contains(text, F.lit("-")), whole(text)).otherwise(text), r"[^\d.,]+", "",
    ))
    # A failed cast costs an exception, so empty text is ruled out first.
    return let(let(digits, pointed), lambda number: F.when(number != "", number.try_cast("double")))


def repair_ocr_money(c: Column | str) -> Column:
    """P1 after dropping a leaked ``20`` or ``0`` prefix (``2016,90``)."""
    value = F.regexp_replace(text_of(c), rf"(?iu){SPACES}|Kč", "")
    value = F.regexp_replace(value, "^([^,]*),-", "$1,00")
    value = F.regexp_replace(value, r"^20(?=\d{2},\d{2}$)", "")
    return parse_money(F.regexp_replace(value, r"^0(?=\d{2,3},\d{2}$)", ""))


def to_number(c: Column | str) -> Column:
    """Finite number or null."""
    number = col(c).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def to_cents(price: Column | str) -> Column:
    """Price in whole cents, halves rounded up."""
    return F.floor(col(price) * 100 + 0.5)


def round_cents(price: Column | str) -> Column:
    return to_cents(price) / 100


def money_text(price: Column | str, whole_decimals: int = 0) -> Column:
    """Czech money text; integers get ``whole_decimals`` decimals."""
    value = col(price).cast("double")
    digits = F.translate(F.format_number(value, 2), ",.", f"{NBSP},")
    if whole_decimals == 0:
        digits = F.regexp_replace(digits, ",00$", "")
    return F.coalesce(F.concat(digits, F.lit(" Kč")), F.lit(""))


def number_text(price: Column | str) -> Column:
    """Number as JavaScript prints it (``69`` rather than ``69.0``)."""
    value = col(price).cast("double")
    return F.coalesce(
        F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string")), F.lit("")
    )


def extract_prices(c: Column | str, normalized: bool = False) -> Column:
    """P5: distinct price literals in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(as_normalized(c, normalized), F.lit(PRICE_LITERAL), F.lit(0)))


def price_markers(c: Column | str) -> Column:
    """``array<struct<pos, price, kind>>`` of ``< 12,90 Kč`` / ``za 12,90 Kč``."""
    lowest, bundle = r"<\s*\d{1,4}[,.]\d{1,2}\s*Kč", r"za\s+\d{1,4}[,.]\d{1,2}\s*Kč"
    pattern = rf"(?iu){opening(lowest, bundle)}(?:{lowest}|{EDGE_L}{bundle})"
    return F.transform(
        match_positions(c, pattern),
        lambda m: F.struct(
            m["pos"].alias("pos"),
            parse_money(m["match"]).alias("price"),
            F.when(m["match"].startswith("<"), F.lit("action-lt")).otherwise(F.lit("za-price")).alias("kind"),
        ),
    )


def classify_price(c: Column | str) -> Column:
    """Every price literal with the reasons it may not be the current price.

    A price after ``<`` is the lowest price of the last 30 days, not the current
    one; both stay in the result and the caller names the policy.
    """

    # A character that every match holds, looked for once a text, spares the texts without it the search around each price.
    def flagged(value: Column) -> Column:
        seen = F.struct(
            value.rlike("(?iu)nejnižší cena").alias("lowest"), value.rlike("(?iu)á").alias("deposit"), value.rlike("(?iu)[*ěš]").alias("crossed"),
        )
        return let(seen, lambda s: priced(value, s))

    def priced(value: Column, seen: Column) -> Column:
        def one(m: Column) -> Column:
            before = F.substring(value, F.greatest(m["pos"] - 49, F.lit(1)), F.least(m["pos"], F.lit(50)))
            after = F.substring(value, m["pos"] + F.length(m["match"]) + 1, F.lit(45))
            return let(F.struct(before.alias("before"), after.alias("after")), lambda a: judged(m, a["before"], a["after"]))

        def judged(m: Column, before: Column, after: Column) -> Column:
            around = F.concat(before, after)
            unit_end = F.right(F.rtrim(before, F.lit(" \t\n\x0b\f\r\u0085\u2028\u2029")), F.lit(1)).isin(*"gGlLsSſ")
            return F.struct(
                m["pos"].alias("pos"),
                parse_money(m["match"]).alias("price"),
                ((F.contains(before, F.lit("<")) & before.rlike(r"<\s*$")) | (seen["lowest"] & before.rlike("(?iu)nejnižší cena"))).alias("isLowest30"),
                (
                    (F.contains(after, F.lit("/")) & after.rlike(r"(?iu)/\s*(?:1\s*)?(?:l|kg|g|ks|100\s*g|100\s*ml)"))
                    | after.rlike(r"(?iu)^\s*(?:Kč\s*)?(?:/|za\s*1|1\s*(?:l|kg|g|ks))")
                    | (unit_end & before.rlike(rf"(?iu){EDGE_L}(?:100\s*g|100\s*ml|1\s*l|1\s*kg|1\s*ks)\s*$"))
                ).alias("isUnitPrice"),
                (seen["deposit"] & around.rlike("(?iu)záloha")).alias("isDeposit"),
                (seen["crossed"] & around.rlike(r"(?iu)\*\*|běžně|škrtaná")).alias("isOldCrossed"),
                (m["match"] == "00,00").alias("isDummy"),
            )

        found = F.transform(match_positions(value, BARE_PRICE), one)
        return F.filter(found, lambda p: p["isDummy"] | p["price"].between(1, 9999))

    return let(text_of(c), flagged)


def pick_current_price(prices: Column, allow_lowest30: bool = False) -> Column:
    """First classified price with no exclusion flag set."""

    def usable(p: Column) -> Column:
        excluded = p["isUnitPrice"] | p["isDeposit"] | p["isOldCrossed"] | p["isDummy"]
        return ~excluded if allow_lowest30 else ~(excluded | p["isLowest30"])

    return F.try_element_at(F.filter(prices, usable), F.lit(1))["price"]


def line_price(line: Column) -> Column:
    """First ``12,90 Kč`` of a line."""
    return let(F.regexp_extract(line, rf"(?iu)({AMOUNT})\s*Kč", 1), lambda found: F.when(found != "", parse_money(found)))


def pick_card_price(lines: Column) -> Column:
    """``struct<pos, price, priceType>``; the loyalty-card price wins.

    ``lines`` is the array of lines of one block; ``pos`` is 1-based.
    """
    card = F.array_position(F.transform(lines, lambda line: line.rlike(rules.LOYALTY_LINE)), True).cast("int")

    def candidate(line: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("pos"), line_price(line).alias("price"))

    def choose(priced: Column, card: Column) -> Column:
        by_card = F.try_element_at(F.filter(priced, lambda p: (card > 0) & (p["pos"] > card)), F.lit(1))
        return F.when(by_card.isNotNull(), F.struct(by_card["pos"], by_card["price"], F.lit("s kartou").alias("priceType"))).when(
            F.size(priced) > 0, F.struct(priced[0]["pos"], priced[0]["price"], F.lit("akční cena").alias("priceType"))
        )

    found = F.filter(F.transform(lines, candidate), lambda p: p["price"].isNotNull())
    return let(found, lambda priced: let(card, lambda at: choose(priced, at)))


def _unit_label(base: Column) -> Column:
    return F.when(base != "", F.concat(F.lit("Kč/"), F.regexp_replace(base, r"\s+", " "))).otherwise(F.lit(""))


def parse_unit_price(c: Column | str, normalized: bool = False) -> Column:
    """P10: first unit price anywhere in a text -> struct(unitPrice, unit, unitText)."""
    bases = "|".join(rules.UNIT_BASES)
    pattern = rf"(?iu)({bases})\s*(?:=|od|za)?\s*(\d{{1,4}}(?:\s?\d{{3}})?[,.]\d{{2}}\s*Kč)"

    def parts(literal: Column) -> Column:
        return F.when(
            literal != "",
            F.struct(
                parse_money(F.regexp_extract(literal, pattern, 2)).alias("unitPrice"),
                _unit_label(F.regexp_extract(literal, pattern, 1)).alias("unit"),
                literal.alias("unitText"),
            ),
        )

    return let(F.regexp_extract(as_normalized(c, normalized), pattern, 0), parts)


_UNIT_LINE = rf"(?iu)^(\d+(?:[ ,]\d+)?\s*(?:kg|g|l|ml|ks))\s+({AMOUNT})\s*Kč$"


def is_unit_line(c: Column | str) -> Column:
    """P10: ``parse_unit_line`` has a result."""
    return F.trim(text_of(c)).rlike(_UNIT_LINE)


def parse_unit_line(c: Column | str) -> Column:
    """P10: a line that is exactly ``<amount unit> <price> Kč``."""
    def parts(text: Column) -> Column:
        return let(F.regexp_extract(text, _UNIT_LINE, 1), lambda base: F.when(
            base != "",
            F.struct(parse_money(F.regexp_extract(text, _UNIT_LINE, 2)).alias("unitPrice"), _unit_label(base).alias("unit")),
        ))

    return let(F.trim(text_of(c)), parts)


def parse_unit_multi(c: Column | str) -> Column:
    """P10: ``100 g 12,90/14,90 Kč`` -> struct(unitBase, unitPrices[], unit)."""
    pattern = rf"(?iu)^(.+?)\s+({LOOSE_AMOUNT}(?:\s*[/–-]\s*{LOOSE_AMOUNT})*)\s*Kč$"
    text = text_of(c)
    base = squeeze(F.regexp_extract(text, pattern, 1))
    numbers = F.array_compact(F.transform(F.split(F.regexp_extract(text, pattern, 2), "[/–-]"), parse_money))
    return F.when(
        base != "", F.struct(base.alias("unitBase"), numbers.alias("unitPrices"), _unit_label(base).alias("unit"))
    )


def parse_base_price(c: Column | str) -> Column:
    """P10: tile text ``(=1 kg 129,90)`` -> struct(unitPrice, unit)."""
    pattern = r"(?iu)=?\s*(\d+(?:[,.]\d+)?\s*(?:kg|g|l|ml|ks|m))\s+(\d+(?:[,.]\d+)?)"

    def parts(text: Column) -> Column:
        return let(F.regexp_extract(text, pattern, 1), lambda base: F.when(
            base != "", F.struct(parse_money(F.regexp_extract(text, pattern, 2)).alias("unitPrice"), _unit_label(base).alias("unit")),
        ))

    return let(text_of(c), parts)


def round_retail(price: Column | str) -> Column:
    """Cents 91-94 -> .90, 96-99 -> next whole, 1-4 -> whole."""

    def rounded(cents: Column) -> Column:
        rest, whole = cents % 100, F.floor(cents / 100)
        return (
            F.when(rest.between(91, 94), whole + 0.9)
            .when(rest.between(96, 99), (whole + 1).cast("double"))
            .when(rest.between(1, 4), whole.cast("double"))
            .otherwise(cents / 100)
        )

    return let(to_cents(price), rounded)


def snap_tenth(price: Column | str) -> Column:
    """To one decimal when within 0.025, else to two."""

    def snapped(value: Column) -> Column:
        tenth = F.floor(value * 10 + 0.5) / 10
        return F.when(F.abs(value - tenth) <= 0.025, tenth).otherwise(round_cents(value))

    return let(col(price), snapped)


def parse_validity(c: Column | str) -> Column:
    """struct(validFrom, validTo); the last dated ``do`` wins."""

    def dated(prefix: str, index: int) -> Column:
        pattern = F.lit(rf"(?iu)(?={prefix[0]}){EDGE_L}{prefix}\s+[^\d]*(\d{{1,2}}\.\s*\d{{1,2}}\.\s*\d{{4}})")
        found = F.regexp_extract_all(text_of(c), pattern, F.lit(1))
        return F.try_to_date(F.regexp_replace(F.try_element_at(found, F.lit(index)), r"\s+", ""), "d.M.yyyy")

    return F.struct(dated("od", 1).alias("validFrom"), dated("do", -1).alias("validTo"))


def lead_prices(head: Column | str) -> Column:
    """Prices printed ahead of the products, old prices (``x / n%``) left out."""
    found = F.regexp_extract_all(text_of(head), F.lit(rf"({AMOUNT})(?!\s*/\s*\d+\s*%)"), F.lit(1))
    return F.array_compact(F.transform(found, parse_money))


def action_price_plausible(price: Column | str) -> Column:
    """P20: retail action prices end in 00, 90 or 99 cents."""
    return F.coalesce((to_cents(price) % 100).isin(*rules.RETAIL_CENTS), F.lit(False))


def discount_share(price: Column | str, old_price: Column | str) -> Column:
    """Share taken off the old price, null without one."""
    return F.when(col(old_price) > 0, 1 - col(price) / col(old_price))


def nearest_price(price: Column, references: Column) -> Column:
    """R2: struct(diff, price) of the closest reference (first on a tie)."""
    ranked = F.transform(
        F.array_compact(references),
        lambda r, pos: F.struct(F.abs(price - r).alias("diff"), pos.alias("pos"), r.alias("price")),
    )
    return F.when(price.isNotNull(), F.array_min(ranked))


def price_close(a: Column, b: Column, tolerance: float = rules.CLOSE_PRICE) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def price_conflict(price: Column, context: Column, unit_price: Column) -> Column:
    """The context prints another main price and ours looks computed."""

    def judged(explicit: Column) -> Column:
        close = F.exists(explicit, lambda e: price_close(e, price))
        rival = F.exists(explicit, lambda e: (e >= 5) & (F.abs(e - price) >= 0.5))
        cents = to_cents(price - F.floor(price))
        nearest = F.array_min(F.transform(explicit, lambda e: F.abs(e - price)))
        off_by_rounding = nearest.between(0.5, 1.5) & (price == F.floor(price))
        return ~close & rival & (cents.isin(*rules.COMPUTED_CENTS) | off_by_rounding)

    numbers = F.filter(
        F.transform(extract_prices(context), parse_money),
        lambda p: (p > 0) & (p < 10000) & ~price_close(p, F.nullif(unit_price, F.lit(0.0)), 0.01),
    )
    return F.coalesce(let(numbers, judged), F.lit(False))
