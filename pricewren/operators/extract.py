"""Page rows -> offer rows (rows X1-X15 of the inventory).

A page is one row, so finding the blocks of a page is a Column expression that
cuts its text at the right places; one generator then emits a row per block.
None of these operators shuffles: work is spread by page, and the page that
holds many blocks is still bounded by the size of a single cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricewren.functions import html as H, money as M, names as N, package as K, quality as Q
from pricewren.functions.patterns import EDGE_L, EDGE_R, LETTER
from pricewren.functions.text import (
    compact_text, each, first_text, let, normalize_for_index, normalize_line, normalize_search, normalize_text,
    remove_page_noise, single_line, squeeze, strip, text_of,
)
from pricewren.operators.enrich import category_by_page_range, guess_category
from pricewren.operators.match import BROADCAST_NEEDLES, SIZES, bit_table, bits_for, in_bit_table
from pricewren.session import staged


_ALL = 1_000_000_000  # slice length meaning "to the end" (start + length must fit an int)


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def once_per_page(pages: DataFrame, extract: Callable[[DataFrame, Sequence[str]], DataFrame], inputs: Sequence[str],
                  keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``extract(pages, keep)`` for feeds that carry the same page many times: each distinct page is read once.

    ``inputs`` are the columns that ``extract`` reads.  The distinct inputs are parsed, and
    their rows are joined back by 128 bits of hash, so the feed itself moves only with ``keep`` and
    the hash, never with its text.  A page without rows meets nothing in the join, and a
    page that is all over the feed is a join that Spark splits at run time.  Where no page
    repeats, this costs a shuffle of the texts; the operators alone need none.
    """
    inputs, keep = list(inputs), list(keep)
    hashes = {"_page_a": F.xxhash64(*inputs), "_page_b": F.xxhash64(F.lit(1), *inputs)}
    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # parsing costs far more than the size of the texts tells
    distinct = pages.select(*inputs).distinct().withColumns(hashes).repartition(count, *hashes)
    found = extract(distinct, tuple(hashes))
    names = [n for c in found.columns for n in (keep if c == "_page_a" else [] if c == "_page_b" else [c])]
    return pages.select(*keep, *[h.alias(n) for n, h in hashes.items()]).join(found.hint("merge"), list(hashes)).select(*names)


# --- headings ----------------------------------------------------------------
def extract_heading_blocks(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Every heading opens a block; one offer per block with a price.

    The price follows the loyalty-card rule (P9); the unit price is the first
    one *after* the price line.
    """
    chunks = F.slice(F.split(H.html_line_text(html), "\n### "), 2, _ALL)

    def titled(chunk: Column) -> Column:
        return let(
            F.filter(F.split(chunk, "\n"), lambda v: v != ""),
            lambda lines: F.struct(
                F.regexp_replace(F.coalesce(_first(lines), F.lit("")), r"^#+\s*", "").alias("product"),
                F.slice(lines, 2, _ALL).alias("body"),
            ),
        )

    def priced(b: Column) -> Column:
        return F.struct(b["product"].alias("product"), b["body"].alias("body"), M.pick_card_price(b["body"]).alias("price"))

    def first_line(b: Column, pattern: str) -> Column:
        return F.coalesce(_first(F.filter(b["body"], lambda v: v.rlike(pattern))), F.lit(""))

    def offer(b: Column) -> Column:
        later = F.slice(b["body"], b["price"]["pos"] + 1, _ALL)
        return let(
            M.parse_unit_line(_first(F.filter(later, M.is_unit_line))),
            lambda unit: F.struct(
                b["product"].alias("product"),
                F.coalesce(_first(F.filter(b["body"], lambda v: K.is_package(v))), F.lit("")).alias("packageSize"),
                b["price"]["price"].alias("price"), b["price"]["priceType"].alias("priceType"),
                F.coalesce(unit["unitPrice"], b["price"]["price"]).alias("unitPrice"),
                F.coalesce(unit["unit"], F.lit("Kč/ks")).alias("unit"),
                first_line(b, r"(?iu)^od\s").alias("validFrom"), first_line(b, r"(?iu)^do\s").alias("validTo"),
            ),
        )

    named = each(chunks, titled, lambda b: ~N.bad_heading_name(b["product"]))
    offers = each(each(named, priced, lambda b: b["price"].isNotNull()), offer)
    return pages.select(*keep, F.posexplode(offers).alias("block", "_o")).select(*keep, "block", "_o.*")


# --- unit-price segments -----------------------------------------------------
def extract_unit_segments(pages: DataFrame, line: str = "line", page: str = "page_number",
                          keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Product, package and unit prices of every unit-price segment.

    ``line`` is the content line of a page (T22).  ``ordinal`` counts the
    products of the page and selects the lead price at the same position.
    """
    cleaned = pages.withColumn("_clean", remove_page_noise(line, F.col(page)))
    cut = cleaned.withColumn("_start", N.first_product_start("_clean")).withColumns(
        {
            "leadPrices": M.lead_prices(F.expr("substring(_clean, 1, _start - 1)")),
            "_body": F.expr("substring(_clean, _start, length(_clean))"),
            "_dates": M.parse_validity(line),
        }
    )

    def split_segment(raw: Column) -> Column:
        segment = N.trim_leading_junk(raw)
        at = F.regexp_instr(segment, F.lit(f"(?iu){N.UNIT_PRICE_SEGMENT}"))
        return F.struct(
            F.substring(segment, F.lit(1), at - 1).alias("before"),
            F.regexp_extract(segment, f"(?iu){N.UNIT_PRICE_SEGMENT}", 0).alias("unitText"),
        )

    def locate(part: Column) -> Column:
        prefix = F.regexp_extract(part["before"], rf"(?isu)^(.*){N.LAST_PACKAGE}", 1)
        # The greedy prefix may swallow leading digits of the last package.
        prefix = F.regexp_replace(prefix, r"(?:\d+\s*x\s*)?(?:\d+[ ,])?\d*(?:\s*[/–-]\s*\d*)?$", "")
        return F.struct(
            prefix.alias("prefix"), K.last_package(part["before"]).alias("packageSize"), part["unitText"].alias("unitText")
        )

    def name(part: Column) -> Column:
        # An unparsed price counts wherever it stands before the package, so it is looked for before the descriptors are cut.
        return let(N.clean_segment_prefix(part["prefix"]), lambda prefix: F.struct(
            N.shorten_segment_name(prefix).alias("product"), N.has_unparsed_price(prefix).alias("unparsed"),
            part["packageSize"].alias("packageSize"), part["unitText"].alias("unitText"),
        ))

    located = each(each(N.segment_texts("_body"), split_segment), locate, lambda p: p["packageSize"] != "")
    segments = each(located, name, lambda p: ~N.bad_segment_name(p["product"]))

    def priced(p: Column, ordinal: Column) -> Column:
        return F.struct(
            ordinal.alias("ordinal"), p["product"].alias("product"), p["packageSize"].alias("packageSize"),
            F.when(~p["unparsed"], M.parse_unit_multi(p["unitText"])).alias("unit"),
        )

    rows = F.filter(F.transform(segments, priced), lambda p: p["unit"].isNotNull())
    return cut.select(*keep, page, "leadPrices", "_dates", F.explode(rows).alias("_s")).select(
        *keep, page, "_s.ordinal", "leadPrices", "_s.product", "_s.packageSize",
        F.col("_s.unit.unitBase").alias("unitBase"), F.col("_s.unit.unitPrices").alias("unitPrices"),
        F.col("_s.unit.unit").alias("unit"), F.col("_dates.validFrom").alias("validFrom"), F.col("_dates.validTo").alias("validTo"),
    )


# --- bullets -----------------------------------------------------------------
def extract_bullet_blocks(pages: DataFrame, text: str = "text", page: str = "page_number",
                          keep: Sequence[str] = ("page_id",), prefix: str = "offer-") -> DataFrame:
    """A run of bullet lines is a block, the lines above it are its name.

    At most the last three lines between two bullet runs that are neither
    slogans nor bare prices form the name.  ``rawContext`` is the whole block.
    """
    lines = F.filter(F.transform(F.split(normalize_text(text), "\n"), normalize_line), lambda v: v != "")
    marked = F.regexp_replace(F.array_join(lines, "\n"), r"(?m)^(•[^\n]*)\n(?!•)", "$1\u0001")

    def halves(chunk: Column) -> Column:
        at = F.when(F.startswith(chunk, F.lit("•")), F.lit(1)).otherwise(F.instr(chunk, F.lit("\n•")) + 1)
        return let(
            at,
            lambda a: F.struct(
                F.split(F.substring(chunk, F.lit(1), a - 1), "\n").alias("gap"),
                F.split(F.substring(chunk, a, F.length(chunk)), "\n").alias("bullets"),
            ),
        )

    def read(b: Column) -> Column:
        names = F.filter(b["gap"], lambda v: (v != "") & ~N.marketing_line(v) & ~N.price_only_line(v))
        return let(
            names,
            lambda n: let(
                F.array_join(b["bullets"], " "),
                lambda t: F.struct(
                    F.slice(n, F.greatest(F.size(n) - 2, F.lit(1)), 3).alias("names"), b["bullets"].alias("bullets"),
                    t.alias("text"), K.extract_package(t, True).alias("package"), M.parse_unit_price(t, True).alias("unit"),
                ),
            ),
        )

    def offer(b: Column) -> Column:
        return F.struct(
            b["names"].alias("names"), b["bullets"].alias("bullets"), b["text"].alias("text"),
            b["package"].alias("packageSize"), b["unit"]["unitPrice"].alias("unitPrice"),
            text_of(b["unit"]["unit"]).alias("unit"), text_of(b["unit"]["unitText"]).alias("unitText"),
            N.name_from_lines(b["names"], True).alias("product"),
            explicit_else_computed(b["text"], b["unit"]["unitPrice"], text_of(b["unit"]["unit"]), b["package"], True).alias("price"),
        )

    chunks = F.filter(F.split(marked, "\u0001"), lambda c: c.rlike("(?m)^•"))
    blocks = each(each(chunks, halves), read, lambda b: (b["package"] != "") | b["unit"].isNotNull())
    offers = each(blocks, offer, lambda o: N.good_bullet_name(o["product"]) & (o["price"] > 0) & (o["price"] <= 10000))
    priced = pages.select(*keep, page, F.posexplode(offers).alias("block", "_o")).select(
        *keep, page, "block", F.col("_o.names").alias("_names"), F.col("_o.bullets").alias("_bullets"),
        F.col("_o.text").alias("_bullet_text"), "_o.packageSize", "_o.unitPrice", "_o.unit", "_o.unitText", "_o.product", "_o.price",
    )
    judged = priced.withColumn("rawContext", F.array_join(F.concat("_names", "_bullets"), " "))
    judged = judged.withColumn(
        "suspectReasons",
        Q.block_reasons(F.col("product"), F.col("price"), F.col("unitPrice"), F.col("packageSize"), F.col("rawContext"),
                        F.col("_bullet_text")),
    )
    doubtful = F.size("suspectReasons") > 0
    return judged.select(
        N.row_id(prefix, F.col(page), F.col("product"), F.col("packageSize"), M.number_text("price")).alias("id"),
        *keep, page, "block", "product", N.bullet_description(F.col("_bullets"), True).alias("description"), "packageSize",
        "price", M.money_text("price").alias("priceText"), "unitPrice", "unit", "unitText",
        F.when(F.col("_bullet_text").rlike("(?iu)aplikace"), F.lit("s aplikací / kartou"))
        .otherwise(F.lit("akční cena")).alias("priceType"),
        F.when(doubtful, F.lit("low")).otherwise(F.lit("medium")).alias("confidence"),
        doubtful.alias("suspect"), "suspectReasons", "rawContext",
    )


def explicit_else_computed(bullets: Column, unit_price: Column, unit: Column, package: Column, normalized: bool = False) -> Column:
    """Last explicit price that is not the unit price, else P15."""
    explicit = F.filter(
        F.transform(M.extract_prices(bullets, normalized), M.parse_money),
        lambda p: (p > 0) & (p < 10000)
        & ~F.coalesce(F.abs(p - F.nullif(unit_price, F.lit(0.0))) <= 0.001, F.lit(False)),
    )
    computed = let(
        K.pack_price(unit_price, unit, package), lambda c: F.when((c > 0) & (c < 10000), c)
    )
    return F.coalesce(M.round_retail(F.try_element_at(explicit, F.lit(-1))), computed)


def final_clean(offers: DataFrame) -> DataFrame:
    """Q12: second pass over extracted offers; doubtful rows are flagged."""
    description = F.col("description") if "description" in offers.columns else F.lit("")
    found = offers.withColumn(
        "_final",
        Q.final_reasons(F.col("product"), text_of("packageSize"), F.col("price"), F.col("unitPrice"), text_of("rawContext"), text_of(description)),
    )
    hit = F.size("_final") > 0
    return found.withColumns(
        {
            "confidence": F.when(hit, F.lit("low")).otherwise(F.col("confidence")),
            "suspect": F.col("suspect") | hit,
            "suspectReasons": F.array_union(F.coalesce("suspectReasons", F.array().cast("array<string>")), "_final"),
        }
    ).drop("_final")


_PATTERN = (
    r"(?iu)([A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ0-9][^•]{2,100})\s*•\s*([^•]{0,90})\s*•\s*"
    r"((?:\d+\s*[×x]\s*)?\d+(?:[,.]\d+)?(?:\s*[–-]\s*\d+(?:[,.]\d+)?)?\s*(?:kg|g|ml|l|ks|role))\s*•\s*"
    r"((?:100\s*g|1\s*kg|1\s*l|100\s*ml|1\s*ks|100\s*ks|1\s*role)\s*(?:=|od|za)?\s*\d{1,6}[,.]\d{2}\s*Kč)([^•]{0,140})"
)


def extract_bullet_pattern(pages: DataFrame, text: str = "text", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``product • description • package • unit price`` sequences."""
    def group(hit: Column, index: int) -> Column:
        return F.regexp_extract(hit, _PATTERN, index)

    def read(hit: Column) -> Column:
        unit = F.regexp_extract(group(hit, 4), r"(?iu)^(100\s*g|1\s*kg|1\s*l|100\s*ml|1\s*ks|100\s*ks|1\s*role)", 1)
        return F.struct(
            hit.alias("hit"), N.name_from_pattern(group(hit, 1)).alias("product"),
            N.name_from_pattern(group(hit, 2), 1000).alias("description"), squeeze(group(hit, 3)).alias("packageSize"),
            group(hit, 4).alias("unitText"), F.concat(F.lit("Kč/"), F.regexp_replace(unit, r"\s+", " ")).alias("unit"),
            M.repair_ocr_money(F.regexp_extract(group(hit, 4), r"\d{1,6}[,.]\d{2}", 0)).alias("unitPrice"),
        )

    def price(r: Column) -> Column:
        computed = M.round_cents(_raw_pack_price(r["unitPrice"], r["unit"], r["packageSize"]))
        chosen = let(computed, lambda c: computed_with_close_explicit(group(r["hit"], 5), c))
        return F.struct(r.alias("r"), chosen.alias("price"))

    hits = each(F.regexp_extract_all(single_line(text), F.lit(_PATTERN), F.lit(0)), read, lambda r: ~N.bad_pattern_name(r["product"]))
    offers = each(hits, price, lambda o: (o["price"] > 0) & (o["price"] <= 10000))
    priced = pages.select(*keep, F.posexplode(offers).alias("match", "_o")).select(
        *keep, "match", "_o.r.*", "_o.price"
    ).withColumnRenamed("hit", "_hit")
    reasons = Q.reasons(
        (F.col("product").rlike("(?iu)VÍCE AKCÍ|BĚŽNÁ CENA|BEZ APLIKACE|NEPORAZITELNÉ"), "šum v názvu"),
        (F.col("product").rlike(rf"{EDGE_L}\d{{3,6}}{EDGE_R}"), "čísla v názvu"),
        (F.col("product").rlike("Kč|%|="), "cena v názvu"),
        (F.col("_hit").rlike("(?iu)BĚŽNÁ CENA"), "v okolí běžná cena"),
    )
    return priced.withColumn("suspectReasons", reasons).select(
        *keep, "match", "product", "description", "packageSize", "price", "unitPrice", "unit", "unitText",
        F.when(F.size("suspectReasons") > 0, F.lit("low")).otherwise(F.lit("medium")).alias("confidence"),
        (F.size("suspectReasons") > 0).alias("suspect"), "suspectReasons",
    )


def _raw_pack_price(unit_price: Column, unit: Column, package: Column) -> Column:
    divisor = (
        F.when(unit.rlike(r"(?iu)100\s*g|100\s*ml"), F.lit(100.0))
        .when(unit.rlike(r"(?iu)1\s*kg|1\s*l"), F.lit(1000.0))
        .when(unit.rlike(r"(?iu)1\s*ks|1\s*role"), F.lit(1.0))
    )
    return unit_price * (F.nullif(K.base_amount(package), F.lit(0.0)) / divisor)


def computed_with_close_explicit(after: Column, computed: Column) -> Column:
    """An explicit price within 8 % beats the computed one."""
    explicit = F.filter(
        F.transform(
            F.regexp_extract_all(single_line(after), F.lit(rf"(?iu){EDGE_L}\d{{1,6}}[,.]\d{{2}}\s*Kč|{EDGE_L}\d{{1,4}},-"), F.lit(0)),
            M.repair_ocr_money,
        ),
        lambda p: (p > 0) & (p < 10000),
    )
    return let(
        explicit,
        lambda found: F.when(
            computed > 0,
            F.coalesce(_first(F.filter(found, lambda p: F.abs(p - computed) / F.greatest(computed, F.lit(1.0)) < 0.08)), computed),
        ).otherwise(F.try_element_at(found, F.lit(-1))),
    )


_UNIT_WINDOW = r"(?iu)(?:100\s*g|1\s*kg|1\s*l|100\s*ml|1\s*ks|100\s*ks|1\s*role)\s*(?:=|od|za)?\s*\d{1,6}[,.]\d{2}\s*Kč"
_ANY_PRICE = rf"(?iu){EDGE_L}\d{{1,6}}[,.]\d{{2}}\s*Kč|{EDGE_L}\d{{1,6}}[,.]\d{{2}}{EDGE_R}|{EDGE_L}\d{{1,4}},-"
_ANY_PACKAGE = rf"(?iu){EDGE_L}\d+\s*[×x]\s*\d+(?:[,.]\d+)?\s*(?:kg|g|ml|l|ks){EDGE_R}|{EDGE_L}\d+(?:[,.]\d+)?\s*(?:kg|g|ml|l|ks|role){EDGE_R}"


def _all_prices(c: Column) -> Column:
    return F.filter(
        F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(_ANY_PRICE), F.lit(0))), M.repair_ocr_money),
        lambda p: (p > 0) & (p < 10000),
    )


def extract_by_unit_window(pages: DataFrame, text: str = "text", keep: Sequence[str] = ("page_id",), before: int = 180,
                           after: int = 240, name_before: int = 160) -> DataFrame:
    """Candidates from the neighbourhood of every distinct unit price."""
    flat = pages.withColumn("_flat", single_line(text))
    marks = flat.select(*keep, "_flat", F.explode(H.match_positions("_flat", _UNIT_WINDOW)).alias("_mark"))
    # A repeated literal counts once, at its first position.
    first = marks.filter(F.expr("instr(_flat, _mark.match) = _mark.pos + 1"))
    cut = first.select(
        *keep, F.col("_mark.match").alias("unitText"),
        F.expr(f"substring(_flat, greatest(_mark.pos - {before} + 1, 1), least(_mark.pos, {before}) + {after})").alias("rawContext"),
        F.expr(f"substring(_flat, greatest(_mark.pos - {name_before} + 1, 1), least(_mark.pos, {name_before}))").alias("_before"),
    )
    chunks = F.filter(F.transform(F.split("_before", "•"), lambda p: N.name_from_pattern(p)), lambda n: ~N.bad_pattern_name(n))

    def offer(unit_price: Column) -> Column:
        other = F.filter(_all_prices(F.col("rawContext")), lambda p: F.abs(p - F.coalesce(unit_price, F.lit(-999999.0))) > 0.001)
        return F.struct(
            F.coalesce(F.try_element_at(chunks, F.lit(-1)), F.lit("")).alias("product"),
            F.coalesce(_first(F.regexp_extract_all("rawContext", F.lit(_ANY_PACKAGE), F.lit(0))), F.lit("")).alias("packageSize"),
            F.try_element_at(other, F.lit(-1)).alias("price"), unit_price.alias("unitPrice"),
        )

    found = each(
        F.array(F.try_element_at(_all_prices(F.col("unitText")), F.lit(-1))), offer,
        lambda o: (o["product"] != "") & o["price"].isNotNull(),
    )
    return cut.select(*keep, "unitText", "rawContext", F.inline(found)).select(
        *keep, "product", "packageSize", "price", "unitPrice", "unitText", "rawContext"
    )


def extract_bullet_neighbourhood(pages: DataFrame, text: str = "text", keep: Sequence[str] = ("page_id",), width: int = 6) -> DataFrame:
    """``width`` consecutive bullet parts as one candidate."""
    parts = F.filter(F.transform(F.split(single_line(text), "•"), lambda p: F.trim(p)), lambda p: p != "")

    def window(s: Column) -> Column:
        return F.struct(
            s["i"].alias("part"), N.name_from_pattern(s["p"]).alias("product"),
            F.array_join(F.slice("_parts", s["i"] + 1, width), " • ").alias("nearby"),
        )

    def priced(w: Column) -> Column:
        return F.struct(
            w["part"].alias("part"), w["product"].alias("product"), w["nearby"].alias("nearby"),
            _first(F.regexp_extract_all(w["nearby"], F.lit(_ANY_PACKAGE), F.lit(0))).alias("packageSize"),
            F.try_element_at(_all_prices(w["nearby"]), F.lit(-1)).alias("price"),
        )

    numbered = F.filter(
        F.transform("_parts", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda s: s["i"] < F.size("_parts") - 1
    )
    named = each(numbered, window, lambda w: ~N.bad_pattern_name(w["product"]))
    offers = each(named, priced, lambda o: o["packageSize"].isNotNull() & o["price"].isNotNull())
    return pages.withColumn("_parts", parts).select(*keep, F.inline(offers))


def extract_line_windows(pages: DataFrame, text: str = "text", keep: Sequence[str] = ("page_id",), before: int = 3,
                         after: int = 4) -> DataFrame:
    """Joined lines i-3..i+4 that show a price and a package, distinct."""
    # Lines of a normalised text need their ends cut only; windows of such lines are normalised already.
    lines = F.filter(F.transform(F.split(normalize_text(text), "\n"), strip), lambda v: v != "")
    windows = F.transform(
        "_lines",
        lambda _, i: F.array_join(
            F.slice("_lines", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)) + after + 1), " "
        ),
    )

    def priced(context: Column) -> Column:
        return let(
            F.try_element_at(M.extract_prices(context, True), F.lit(-1)),
            lambda price: F.struct(
                context.alias("rawContext"), price.alias("priceText"), M.parse_money(price).alias("price"),
                F.regexp_extract(context, rf"(?iu){EDGE_L}\d+(?:[,.]\d+)?\s*(?:kg|g|ml|l|ks|role){EDGE_R}", 0).alias("packageSize"),
            ),
        )

    offers = each(
        F.filter(F.array_distinct(windows), lambda w: w.rlike(f"[{LETTER}]")), priced,
        lambda o: o["priceText"].isNotNull() & (o["packageSize"] != ""),
    )
    return pages.withColumn("_lines", lines).select(*keep, F.inline(offers))


# --- price markers -----------------------------------------------------------
def extract_price_marker_candidates(pages: DataFrame, text: str = "text", page: str = "page_number",
                                    keep: Sequence[str] = (), before: int = 260, after: int = 160) -> DataFrame:
    """One candidate per price marker, its name read from the text before."""
    def around(m: Column) -> Column:
        start = F.greatest(m["pos"] - before, F.lit(0)) + 1
        ahead = F.least(m["pos"], F.lit(before))
        return F.struct(
            m["pos"].alias("pos"), m["price"].alias("price"), m["kind"].alias("kind"),
            single_line(F.substring(F.col(text), start, ahead + after)).alias("rawContext"),
            N.name_before_marker(F.substring(F.col(text), start, ahead)).alias("product"),
        )

    found = each(M.price_markers(text), around, lambda c: ~N.bad_candidate_name(c["product"]))
    cut = pages.select(*keep, page, F.inline(found))
    package = F.regexp_extract(
        "rawContext", rf"(?iu){EDGE_L}\d+(?:[,.]\d+)?\s*(?:ml|l|g|kg|ks|balení|plech|sklo|role|rolí|m){EDGE_R}", 0
    )
    tagged = cut.withColumns(
        {
            "priceText": M.money_text("price"), "packageSize": F.regexp_replace(package, r"\s+", " "),
            "category": guess_category(F.col("product"), F.col("rawContext")),
        }
    )
    return tagged.withColumn(
        "score", Q.score_candidate(F.col("category"), F.col("packageSize"), F.col("kind"), F.col("product"), F.col("rawContext"))
    )


# --- dictionaries ------------------------------------------------------------
def extract_dictionary_blocks(pages: DataFrame, starts: Sequence[str] | DataFrame, text: str = "text",
                              keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Blocks from one known product start to the next, accents and case apart.

    ``starts`` is a list or a table (column ``start``) of any size.  Where several
    starts share a position the longest names the block; of equal ones the first of
    the list, or the smallest of the table.

    One pass over a page: the few characters that follow each position are looked up
    in a bit table of the starts' first grams, whose size is fixed, inside the row; the
    page is cut at the positions that pass.  Only these pieces leave the row.  The gram tells
    the lengths of the starts that begin with it, and an equi join on the whole start finds those of
    these lengths: however many starts share a gram, a position is looked up once a length.
    Pieces without a start are joined to the block before them.
    The work is linear in the page, and the plan the same for every dictionary.
    Characters beyond the basic plane count as alike.
    """
    spark = pages.sparkSession
    if isinstance(starts, DataFrame):
        listed = starts.filter("start is not null").select("start", F.lit(0).alias("_order")).distinct()
    else:
        listed = spark.createDataFrame([(s, i) for i, s in enumerate(starts)], "start string, _order int")
    basic = lambda c: F.regexp_replace(normalize_for_index(c), r"[\x{10000}-\x{10FFFF}]", "\ufffc")
    size = F.lit(SIZES[-1])
    for n in reversed(SIZES):
        size = F.when(F.length("_fold") >= n, F.lit(n)).otherwise(size)
    known = staged(
        listed.withColumn("_fold", basic("start")).filter("_fold <> ''").groupBy("_fold").agg(F.min(F.struct("_order", "start"))["start"].alias("start"))
        .withColumn("_size", size).withColumn("_gram", F.expr("left(_fold, _size)")), "starts",
    )
    measured = known.agg(F.max(F.length("_fold")).alias("longest"), F.count_distinct("_gram").alias("grams"), F.count(F.lit(1)).alias("starts")).first()
    longest, bits = measured["longest"] or 1, bits_for(measured["grams"])

    def heads(window: Column, table: Column) -> Column:
        """The grams at a position that some start begins with."""
        grams = [F.when(F.array_contains(table["sizes"], n), F.left(window, F.lit(n))) for n in SIZES]
        return F.filter(F.array_distinct(F.array_compact(F.array(*grams))), lambda g: in_bit_table(g, table["bits"], bits))

    rows = pages.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text")).withColumn("_table", bit_table(known, bits))
    windows = F.regexp_extract_all(basic("_text"), F.lit(rf"(?s)(?=(.{{1,{longest}}}))"), F.lit(1))
    candidates = F.filter(
        F.transform(windows, lambda w, i: F.struct((i + 1).alias("at"), w.alias("window"), heads(w, F.col("_table")).alias("grams"))),
        lambda c: F.size(c["grams"]) > 0,
    )

    def pieces(found: Column, chars: Column) -> Column:
        end = lambda j: F.coalesce(F.get(found, j + 1)["at"], F.size(chars) + 1)
        return F.transform(found, lambda c, j: F.struct(
            c["at"].alias("at"), c["window"].alias("window"), c["grams"].alias("grams"),
            F.array_join(F.slice(chars, c["at"], F.greatest(end(j) - c["at"], F.lit(0))), "").alias("piece"),
        ))

    cut = let(candidates, lambda found: let(F.split(F.coalesce("_text", F.lit("")), ""), lambda chars: pieces(found, chars)))
    hits = rows.select(*keep, "_row", F.explode(cut).alias("_c")).select(
        *keep, "_row", "_c.at", "_c.window", "_c.piece", F.explode("_c.grams").alias("_gram")
    )
    sized = lambda df, n: F.broadcast(df) if n <= BROADCAST_NEEDLES else df.hint("merge")
    lengths = known.groupBy("_gram").agg(F.collect_set(F.length("_fold")).alias("_lengths"))
    prefixes = F.transform(F.filter("_lengths", lambda n: n <= F.length("window")), lambda n: F.left(F.col("window"), n))
    sought = hits.join(sized(lengths, measured["grams"]), "_gram", "left").select(*keep, "_row", "at", "piece", F.posexplode_outer(prefixes).alias("_i", "_sought"))
    # A piece travels once a gram, beside the first of its prefixes.
    sought = sought.withColumn("piece", F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("piece"))).drop("_i")
    matched = sought.join(sized(known.select("_fold", "start"), measured["starts"]), F.col("_sought") == F.col("_fold"), "left").filter("_fold is not null or piece is not null")
    # max_by skips nulls: the longest start, or none.
    named = matched.groupBy("_row", *keep, "at").agg(F.max_by("start", F.length("_fold")).alias("start"), F.max("piece").alias("piece"))
    block = F.count("start").over(Window.partitionBy("_row").orderBy("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    blocks = named.withColumn("_block", block).filter("_block > 0").groupBy("_row", *keep, "_block").agg(
        (F.min("at") - 1).alias("pos"), F.min_by("start", "at").alias("start"), single_line(joined).alias("block")
    )
    return blocks.select(*keep, "pos", "start", "block")


def dictionary_offers(blocks: DataFrame) -> DataFrame:
    """Name, package, unit price and action price of dictionary blocks."""
    package = F.regexp_extract_all("block", F.lit(rf"(?iu){EDGE_L}\d+(?:[,.]\d+)?\s*(?:ml|l|g|kg|ks|balení|sáčků|kapslí){EDGE_R}"), F.lit(0))
    real = F.filter(package, lambda p: ~p.rlike(r"(?iu)^(?:100\s*g|1\s*kg)$"))
    unit = rf"(?iu){EDGE_L}(100\s*g|1\s*kg)\s+(\d{{1,4}}[,.]\d{{1,2}})\s*Kč"
    marked = blocks.filter(F.col("block").rlike(r"(?iu)<\s*\d{1,4}[,.]\d{1,2}\s*Kč"))
    return marked.withColumns(
        {
            "product": N.name_from_block("block"),
            "packageSize": F.regexp_replace(F.coalesce(_first(real), _first(package), F.lit("")), r"\s+", " "),
            "unit": F.regexp_replace(F.regexp_extract("block", unit, 1), r"\s+", " "),
            "unitPrice": M.parse_money(F.regexp_extract("block", unit, 2)),
            "price": M.parse_money(F.regexp_extract("block", r"(?iu)<\s*(\d{1,4}[,.]\d{1,2})\s*Kč", 1)),
        }
    )


def missing_starts(blocks: DataFrame, starts: Sequence[str] | DataFrame) -> DataFrame:
    """Dictionary entries (a list, or a table with the column ``start``) that no page contains."""
    known = starts.select("start") if isinstance(starts, DataFrame) else blocks.sparkSession.createDataFrame([(s,) for s in starts], "start string")
    return known.join(blocks.select("start").distinct(), "start", "left_anti")


def pair_by_ordinal(pages: DataFrame, prices: Column, blocks: Column, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """X11: n-th price with n-th product of the same page, mismatch flagged."""
    return pages.withColumns({"_prices": prices, "_blocks": blocks}).select(
        *keep, (F.size("_prices") != F.size("_blocks")).alias("countMismatch"), "_prices",
        F.posexplode("_blocks").alias("ordinal", "product"),
    ).withColumn("price", F.expr("get(_prices, ordinal)")).drop("_prices")


def pair_tables_by_ordinal(prices: DataFrame, products: DataFrame, keys: Sequence[str]) -> DataFrame:
    """X11 for two tables that carry an ``ordinal``: left join on page and position."""
    return products.join(prices, [*keys, "ordinal"], "left")


# --- upper-case lines --------------------------------------------------------
def extract_uppercase_lines(pages: DataFrame, text: str = "text", page: str = "page_number",
                            keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Upper-case product lines with up to four continuation lines.

    The context reaches from eight lines above to nine below the start.
    """
    lines = F.filter(F.transform(F.split(text_of(text), "\n"), squeeze), lambda v: v != "")
    stop = r"(?iu)^\d{1,4}[,.]\d{2}(?![\p{L}\p{N}_])|^(?:<|00,|nabídka|jedinečná|super|cena|nejnižší)"
    size_first = r"(?iu)^\d+(?:[,.]\d+)?\s*(?:g|kg|ml|l|ks|balení|%)"
    sized = rf"(?iu)(?=\d){EDGE_L}\d+(?:[,.]\d+)?\s*(?:ml|l|g|kg|ks|balení){EDGE_R}"

    def grow(state: Column, h: Column) -> Column:
        line, shut = h["line"], F.struct(F.lit(False).alias("open"), state["lines"].alias("lines"))
        plain = (F.length(line) <= 60) & ~line.rlike(size_first)

        def grown(has_size: Column) -> Column:
            added = F.array_compact(F.array(F.when(plain, line), F.when(has_size, line)))
            return F.struct((~has_size).alias("open"), F.concat(state["lines"], added).alias("lines"))

        return F.when(state["open"] & ~h["starts"] & ~line.rlike(stop), let(line.rlike(sized), grown)).otherwise(shut)

    def head(line: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), line.alias("line"), N.product_start_line(line).alias("starts"))

    def assemble(h: Column, all_lines: Column) -> Column:
        begin = F.struct(F.lit(True).alias("open"), F.array(h["line"]).alias("lines"))
        grown = F.aggregate(F.slice(all_lines, h["i"] + 2, 4), begin, grow, lambda s: s["lines"])
        name = F.regexp_replace(F.regexp_replace(F.array_join(grown, " "), r"\*", ""), r"\s*\|\s*$", "")
        above = F.least(h["i"], F.lit(8))
        return F.struct(
            h["i"].alias("line"),
            squeeze(F.regexp_replace(name, r"(?iu)\s+<\s*\d{1,4}[,.]\d{2}\s*Kč.*$", "")).alias("product"),
            F.array_join(F.slice("_lines", h["i"] - above + 1, above + 10), " | ").alias("_context"),
        )

    # Whether a line starts a product is judged once a line; the lines that follow a start ask again.
    products = let(F.transform("_lines", head), lambda judged: each(
        F.filter(judged, lambda h: h["starts"]), lambda h: assemble(h, judged), lambda p: F.length(p["product"]) >= 4,
    ))
    named = pages.withColumn("_lines", lines).select(*keep, page, F.inline(products))
    read = named.withColumn("_prices", M.classify_price("_context"))
    built = read.withColumns(
        {
            "price": M.pick_current_price(F.col("_prices")),
            "lowest30dPrice": _first(F.filter("_prices", lambda p: p["isLowest30"]))["price"],
            "packageSize": K.preferred_package(F.concat_ws(" ", "product", "_context"), "ml|l|g|kg|ks|balení", "role"),
            "category": category_by_page_range(F.col(page), F.col("product")),
            "depositText": F.regexp_extract("_context", r"(?iu)záloha[^|]{0,40}", 0),
        }
    )
    found = Q.reasons(
        (F.col("price").isNull(), "není bezpečně určená aktuální cena"),
        (F.col("packageSize") == "", "chybí balení"),
        (F.length("product") > 80, "dlouhý název produktu"),
        (F.col("product").rlike("[|<>]"), "název obsahuje podezřelé znaky"),
        (F.concat_ws(" ", "product", "_context").rlike("(?iu)záloha|nejnižší cena|používejte|před použitím"),
         "kontext obsahuje zálohu/patičku/bezpečnostní text"),
    )
    return built.withColumn("confidenceReasons", found).select(
        *keep, page, "line", "product", "packageSize", "price", M.money_text("price", 2).alias("priceText"),
        "lowest30dPrice", "depositText", "category",
        Q.confidence_by_reasons(F.col("confidenceReasons"), F.col("price")).alias("confidence"), "confidenceReasons",
        compact_text("_context").alias("rawContext"),
    )


def page_product_lines(pages: DataFrame, text: str = "text", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Likely product lines of a page with their ordinal and lines -2..+3."""
    lines = F.filter(
        F.transform(F.split(text_of(text), r"\r?\n"), lambda v: squeeze(F.regexp_replace(v, "[•●]", " "))), lambda v: v != ""
    )
    found = F.filter(
        F.transform(
            "_lines",
            lambda v, i: F.struct(
                v.alias("product"),
                F.array_join(F.slice("_lines", F.greatest(i - 2, F.lit(0)) + 1, F.least(i, F.lit(2)) + 4), " | ").alias("context"),
            ),
        ),
        lambda s: N.likely_product_line(s["product"]),
    )
    return pages.withColumn("_lines", lines).select(*keep, F.posexplode(found).alias("ordinal", "_f")).select(
        *keep, "ordinal", "_f.product", "_f.context"
    )


def current_prices(text: Column | str) -> Column:
    """X11: prices of a page in order, without unit, old and lowest prices."""
    def usable(m: Column) -> Column:
        return M.parse_money(m).between(1, 9999)

    found = F.regexp_extract_all(
        F.regexp_replace(text_of(text), r"(?iu)(?:<|nejnižší cena|běžně za)\s*\d{1,4}[,.]\d{2}", " "),
        F.lit(r"(?<![\d<])(\d{1,4}[,.]\d{2})(?!\s*/)(?!\s*%)(?!\d)"), F.lit(1),
    )
    return F.transform(F.filter(found, usable), M.parse_money)


# --- tiles and JSON ----------------------------------------------------------
def extract_product_tiles(pages: DataFrame, html: str = "html", url: str = "url", keep: Sequence[str] = ("page_id",),
                          tile: str = "k-product-tile", tag: str = "k-price-tag", article: str = "kloffer-articleID") -> DataFrame:
    """Anchors of product-tile pages as offers."""
    anchor = rf"""(?is)<a{EDGE_R}[^>]*class\s*=\s*["'][^"']*{tile}[^"']*["'][^>]*>.*?</a>"""
    tiles = pages.select(*keep, F.col(url).alias("_url"), F.posexplode(F.regexp_extract_all(html, F.lit(anchor), F.lit(0))).alias("tile", "_tile"))

    def inner(element: str, css: str) -> Column:
        return H.clean_fragment(F.regexp_extract("_tile", rf"""(?is)<{element}[^>]*class=["'][^"']*{css}[^"']*["'][^>]*>(.*?)</""", 1))

    image = F.coalesce(
        F.nullif(F.regexp_extract("_tile", rf"(?is)<img{EDGE_R}[^>]*(?:{tile}__main-image|data-image-fallback|alt=)[^>]*>", 0), F.lit("")),
        F.regexp_extract("_tile", rf"(?is)<img{EDGE_R}[^>]*>", 0),
    )

    def attribute(name: str) -> Column:
        return H.decode_html(F.regexp_extract("_image", rf"""(?i){name}\s*=\s*["']([^"']*)["']""", 1), script_escapes=False)

    number = [
        F.nullif(F.regexp_extract("_tile", p, 1), F.lit(""))
        for p in (rf"(?i){article}=([0-9]+)", r"""(?i)articleID["']?\s*[:=]\s*["']?([0-9]+)""", r"""(?i)klNr["']?\s*[:=]\s*["']?([0-9]+)""")
    ]
    href = F.regexp_extract("_tile", r"""(?i)href\s*=\s*["']([^"']*)["']""", 1)
    read = tiles.withColumn("_image", image).withColumns(
        {
            "klNr": F.coalesce(*number, F.lit("")),
            "sourceUrl": F.when(href != "", H.resolve_url(H.decode_html(href, script_escapes=False), F.col("_url"))).otherwise(F.col("_url")),
            "product": first_text(
                H.clean_fragment(attribute("alt")),
                squeeze(F.concat_ws(" ", inner("[^>]*?", f"{tile}__title"), inner("[^>]*?", f"{tile}__subtitle"))),
                H.clean_fragment(attribute("title")),
            ),
            "price": M.parse_money(inner("div", f"{tag}__price")),
            "oldPrice": M.parse_money(inner("span", f"{tag}__old-price-line-through")),
            "priceType": first_text(inner("div", f"{tag}__discount"), F.lit("akční cena")),
            "packageSize": inner("div", f"{tile}__unit-price"),
            "_base": M.parse_base_price(inner("div", f"{tile}__base-price")),
            "_src": attribute("src"),
        }
    )
    # The offer is built as one struct and dropped in the generator, see ``each``.
    named = F.filter(F.array(F.struct("product", "price")), lambda o: (o["product"] != "") & o["price"].isNotNull())
    return read.withColumn("_kept", F.explode(named)).select(
        *keep, "tile", "klNr", "product", "packageSize", "price", "oldPrice",
        F.coalesce("_base.unitPrice", "price").alias("unitPrice"), F.coalesce("_base.unit", F.lit("Kč/ks")).alias("unit"),
        H.category_from_url("sourceUrl").alias("category"), "priceType",
        H.canonical_image_url(H.resolve_url("_src", F.col("_url"))).alias("imageUrl"), "sourceUrl",
    )


# Candidate field names per offer field: fixed values.
JSON_TEXT_FIELDS = {
    "product": ("productName", "name", "title", "description", "productTitle", "articleName", "klTitle", "text"),
    "packageSize": ("packageSize", "quantity", "weight", "volume", "content", "amount"),
    "imageUrl": ("imageUrl", "image", "imageSrc", "picture", "pictureUrl"),
    "category": ("category", "categoryName", "mainCategory", "klofferCategory"),
    "klNr": ("klNr", "articleId", "productId", "id"),
    "validFrom": ("dateFrom", "validFrom", "startDate"),
    "validTo": ("dateTo", "validTo", "endDate"),
    "unit": ("unit", "baseUnit"),
}
JSON_NUMBER_FIELDS = {
    "price": ("price", "currentPrice", "offerPrice", "salesPrice", "finalPrice", "priceValue"),
    "unitPrice": ("unitPrice", "basePrice", "basicPrice", "pricePerUnit", "referencePrice"),
}


def map_json_offers(items: DataFrame, json: str = "item", keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Offers from JSON items whose field names vary.

    ``json`` is one item as text; every field takes the first non-empty of its
    candidate names.  The item is parsed once, into a map.
    """
    parsed = items.withColumn("_m", F.from_json(F.col(json), "map<string,string>"))

    def text_field(names: Sequence[str]) -> Column:
        return first_text(*[F.trim(F.try_element_at("_m", F.lit(n))) for n in names])

    def number_field(names: Sequence[str]) -> Column:
        return F.coalesce(*[M.parse_money(F.try_element_at("_m", F.lit(n))) for n in names])

    fields = {n: text_field(c) for n, c in JSON_TEXT_FIELDS.items()} | {n: number_field(c) for n, c in JSON_NUMBER_FIELDS.items()}
    mapped = parsed.select(*keep, *[v.alias(n) for n, v in fields.items()])
    known = (F.col("product") != "") | (F.coalesce("price", F.lit(0.0)) != 0) | (F.col("klNr") != "")
    return mapped.filter(known).withColumn("unitPrice", F.coalesce("unitPrice", "price"))


def extract_known_products(pages: DataFrame, facts: DataFrame, text: str = "text", page: str = "page_number") -> DataFrame:
    """Facts (page, product, price) that their page's text confirms.

    The first two long words of the product and the price, printed with a comma,
    a dot or as ``12,-``, must occur.
    """
    words = F.slice(F.filter(F.split(normalize_search("product"), " "), lambda w: F.length(w) >= 4), 1, 2)
    wanted = facts.withColumn("_words", words).filter(F.size("_words") > 0)
    texts = pages.select(page, F.col(text).alias("_text"), normalize_search(text).alias("_folded"))
    price = F.translate(F.format_number("price", 2), ",", "")
    forms = [price, F.translate(price, ".", ","), F.concat(F.regexp_replace(price, r"\..*$", ""), F.lit(",-"))]
    printed = F.contains("_text", forms[0]) | F.contains("_text", forms[1]) | ((F.col("price") % 1 == 0) & F.contains("_text", forms[2]))
    return (
        wanted.join(texts, page)
        .filter(F.forall("_words", lambda w: F.contains("_folded", w)) & printed)
        .select(*facts.columns)
    )
