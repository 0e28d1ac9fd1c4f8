"""Data-quality audits (rows A9-A17, D5-D22 of the inventory).

Groups are reported as counts plus, where rows are wanted, a bounded sample per
group picked by a rank (limited map-side); no group is ever collected whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pricewren import rules
from pricewren.functions import html as H, money as M, quality as Q
from pricewren.functions.patterns import EDGE_L, EDGE_R
from pricewren.functions.text import (
    context_around, flexible_position, let, normalize_for_index, normalize_loose, normalize_search, single_line,
    snippet, text_of,
)
from pricewren.operators.dedupe import dedupe_best
from pricewren.operators.enrich import joined_text
from pricewren.operators.extract import extract_price_marker_candidates
from pricewren.operators.lines import top_k_per_group
from pricewren.operators.match import already_in, count_checks, match_checks, pages_with_counts, substring_join
from pricewren.operators.similar import similar_groups
from pricewren.session import staged


def count_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


# --- structure ---------------------------------------------------------------
def validate_offers(offers: DataFrame, position: str = "seq", required: Sequence[str] = rules.REQUIRED_FIELDS) -> DataFrame:
    """One row per (row position, missing required field)."""
    missing = F.array_compact(F.array(*[
        F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in required
    ]))
    return offers.select(F.col(position), F.explode(missing).alias("field"))


def first_violation(offers: DataFrame, position: str = "seq", required: Sequence[str] = rules.REQUIRED_FIELDS) -> DataFrame:
    """The first missing field in input order (no row when all is well)."""
    rank = F.array_position(F.array(*[F.lit(f) for f in required]), F.col("field"))
    found = validate_offers(offers, position, required).agg(F.min(F.struct(F.col(position), rank.alias("rank"), "field")).alias("v"))
    return found.filter("v is not null").select(f"v.{position}", "v.field")


def profile_fields(offers: DataFrame, article: str = "klNr") -> DataFrame:
    """Totals with a name, a price, an article number."""
    return offers.agg(
        count_rows("total"), F.count_if(text_of("product") != "").alias("withProduct"),
        F.count_if(F.col("price").isNotNull()).alias("withPrice"), F.count_if(text_of(article) != "").alias("withKey"),
    )


def nesting(json: str) -> Column:
    """How deep objects and arrays are nested in a JSON text (brackets inside strings don't count)."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(steps, start, step, lambda s: s["most"])


def schema_profile(items: DataFrame, json: str) -> DataFrame:
    """(path, type) of everything inside JSON texts, with count and sample.

    Each level unnests objects and arrays one step further, down to the deepest
    one of all items, which is measured first (one number); all items count.
    """
    spark = items.sparkSession
    level = items.select(F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).filter("v is not null")
    levels = [level]
    for _ in range(items.agg(F.max(nesting(json))).first()[0] or 0):
        inner = spark.tvf.variant_explode(F.col("v").outer())
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "$", F.col("key")).otherwise(
            F.concat_ws(".", "path", "key")
        )
        level = level.lateralJoin(inner).select(path.alias("path"), F.col("value").alias("v"))
        levels.append(level)
    kind = F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1)
    everything = reduce(DataFrame.union, levels).select("path", kind.alias("type"), F.to_json("v").alias("_text"))
    return everything.groupBy("path", "type").agg(count_rows("count"), F.min("_text").alias("sample"))


def object_keys(items: DataFrame, json: str) -> DataFrame:
    """Per path of objects inside JSON texts, each key with the number of objects that have it."""
    spark = items.sparkSession
    level = items.select(F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).filter("v is not null")
    found = []
    for _ in range(items.agg(F.max(nesting(json))).first()[0] or 0):
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        found.append(inner.filter("key is not null").select("path", "key"))
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "$", F.col("key")).otherwise(
            F.concat_ws(".", "path", "key")
        )
        level = inner.select(path.alias("path"), F.col("value").alias("v"))
    if not found:
        return spark.createDataFrame([], "path string, key string, count long")
    return reduce(DataFrame.union, found).groupBy("path", "key").agg(count_rows("count"))


# --- duplicates --------------------------------------------------------------
def exact_key() -> list[Column]:
    return [F.col("pageNumber").alias("page"), normalize_search("product").alias("name"), F.col("price").alias("price")]


def exact_duplicate_groups(offers: DataFrame) -> DataFrame:
    """(page, name, price) groups with more than one offer."""
    return offers.groupBy(*exact_key()).agg(count_rows("count")).filter("count > 1")


def near_duplicate_groups(offers: DataFrame) -> DataFrame:
    """(page, name without descriptors) groups with more than one offer."""
    keyed = offers.select(F.col("pageNumber").alias("page"), Q.near_duplicate_key(F.col("product")).alias("name"))
    return keyed.groupBy("page", "name").agg(count_rows("count")).filter("name is not null and count > 1")


def similar_name_groups(offers: DataFrame, percent: int = 60) -> DataFrame:
    """A14 at scale: offers with ``groupId``, the smallest id of the same page whose name is connected to theirs.

    Names link where their word sets have a Jaccard similarity of ``percent`` % or more.
    """
    return similar_groups(offers, ["pageNumber"], id_col="id", tokens=F.split(normalize_search("product"), " "), percent=percent)


def _members(offers: DataFrame, key: Sequence[Column], groups: DataFrame) -> DataFrame:
    """The rows of ``offers`` in the counted groups, with the group's count.

    Groups are counted with map-side aggregation; the members then meet them in
    an equi join, whose crowded groups Spark splits at run time.
    """
    names = groups.columns[:-1]
    keyed = offers.select("*", *[c.alias(f"_{n}") for c, n in zip(key, names, strict=True)])
    other = groups.withColumnsRenamed({n: f"_of_{n}" for n in names})
    same = [F.equal_null(keyed[f"_{n}"], other[f"_of_{n}"]) for n in names]
    return keyed.join(other, same).select(*offers.columns, "count")


def duplicate_items(offers: DataFrame) -> DataFrame:
    """Every member of the exact duplicate groups, with the size of its group."""
    return _members(offers, exact_key(), exact_duplicate_groups(offers))


def near_duplicate_items(offers: DataFrame) -> DataFrame:
    """Every member of the near duplicate groups, with the size of its group."""
    key = [F.col("pageNumber"), Q.near_duplicate_key(F.col("product"))]
    return _members(offers, key, near_duplicate_groups(offers))


# --- pages -------------------------------------------------------------------
def count_by_page(offers: DataFrame) -> DataFrame:
    """A9."""
    return offers.groupBy("pageNumber").agg(count_rows("offers"))


def page_bucket_counts(candidates: DataFrame, page: str, bucket: str, values: Sequence[str]) -> DataFrame:
    """A10: candidates per page and bucket, one column per bucket."""
    return candidates.groupBy(page).agg(count_rows("total"), *[F.count_if(F.col(bucket) == v).alias(v) for v in values])


def page_samples(candidates: DataFrame, page: str, order: str, sample: int = 20) -> DataFrame:
    """A10: the first candidates of every page."""
    return top_k_per_group(candidates, [page], sample, F.asc(order))


def rough_markers(text: Column | str) -> Column:
    """struct(pairs, unique, superb, total) of rough price markers.

    ``total`` is the pairs plus the distinct prices of the two kinds of banner.
    """

    def distinct(pattern: str) -> Column:
        return F.size(F.array_distinct(F.regexp_extract_all(text_of(text), F.lit(pattern), F.lit(1))))

    pairs = F.regexp_count(text_of(text), F.lit(rf"{EDGE_L}\d{{1,4}},\d{{2}}\s+\d{{1,4}},\d{{2}}\s*/\s*\d{{1,3}}%"))
    banners = distinct(r"(?iu)nabídka\s+Jedinečná\s+(\d{1,4},\d{2})")
    superb = distinct(r"(?iu)Super\s+Cena!\s+(\d{1,4},\d{2})")
    return let(
        F.array(pairs, banners, superb),
        lambda a: F.struct(a[0].alias("pairs"), a[1].alias("unique"), a[2].alias("superb"), (a[0] + a[1] + a[2]).alias("total")),
    )


def rough_product_lines(text: Column | str) -> Column:
    """Number of lines that look like a product."""
    lines = F.transform(F.split(text_of(text), r"\n+"), lambda v: F.trim(v))
    noise = (
        r"(?iu)^(?:00|00,00|<|nabídka|Jedinečná|Super|Cena|nízké ceny|Nejnižší cena|MAX\.|osoba|den|ilustrační foto)$"
        r"|^\d{1,4},\d{2}$|^\d+\s*(?:g|kg|ml|l|ks|m)$"
    )
    return F.size(F.filter(lines, lambda v: (F.length(v) >= 4) & ~v.rlike(noise) & v.rlike("[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]{3,}")))


def page_gap_audit(pages: DataFrame, offers: DataFrame, text: str = "text", page: str = "pageNumber", gap: int = 5) -> DataFrame:
    """Pages that print clearly more prices than there are offers."""
    marked = pages.select(page, F.length(text).alias("textLength"), rough_product_lines(text).alias("productLines"), rough_markers(text).alias("_m"))
    joined = pages_with_counts(marked, offers, page)
    scored = joined.select(
        page, "textLength", "productLines", F.col("_m.total").alias("markers"), "offers",
        F.greatest(F.col("_m.total") - F.col("offers"), F.lit(0)).alias("gapScore"),
    )
    return scored.filter((F.col("markers") > 0) & ((F.col("gapScore") >= gap) | (F.col("offers") == 0)))


def coverage_risk(action_markers: Column, offers: Column, missing: Column, useful: Column, first_page: Column) -> Column:
    """How likely a page misses offers."""
    return (
        F.when(first_page | (action_markers == 0), F.lit("none"))
        .when((missing >= 8) | (action_markers >= offers + 10), F.lit("high"))
        .when((missing >= 4) | (action_markers >= offers + 5), F.lit("medium"))
        .when((missing >= 1) | (useful >= 3), F.lit("low"))
        .otherwise(F.lit("none"))
    )


def coverage_candidates(pages: DataFrame, text: str = "text", page: str = "pageNumber") -> DataFrame:
    """Best-scored copy of every price-marker candidate."""
    found = extract_price_marker_candidates(pages, text, page)
    return dedupe_best(found, F.col("score"), ["pos"], [page, normalize_loose("product"), "price"])


def coverage_audit(pages: DataFrame, offers: DataFrame, text: str = "text", page: str = "pageNumber", useful: int = 3) -> DataFrame:
    """Markers, candidates, missing candidates and risk per page."""
    # Parsed once: the candidates feed the counts and every branch of the anti join.
    candidates = staged(coverage_candidates(pages, text, page), "coverage-candidates")
    good = candidates.filter(F.col("score") >= useful)
    known = offers.withColumn("_text", normalize_loose(joined_text(offers, ("product", "description", "searchTerms", "category"))))
    covered = already_in(good, known, F.col("_text"), normalize_loose, page).select(
        F.col("page").alias("_page"), F.col("name").alias("_name"), F.lit(True).alias("_hit")
    )
    keyed = good.withColumn("_loose", normalize_loose("product"))
    judged = keyed.join(covered.hint("merge"), (keyed[page] == F.col("_page")) & (F.col("_loose") == F.col("_name")), "left")
    missing = judged.groupBy(page).agg(count_rows("useful"), F.count_if(F.col("_hit").isNull()).alias("missing"))
    actions = lambda found: F.size(F.filter(found, lambda m: m["kind"] == "action-lt"))
    numbers = let(M.price_markers(text), lambda found: F.struct(F.size(found).alias("markers"), actions(found).alias("actionMarkers")))
    base = pages.select(page, F.length(text).alias("textLength"), numbers.alias("_numbers"))
    # Taken apart behind the join, so that a page's markers are looked for once.
    counted = pages_with_counts(base, offers, page).select(page, "textLength", "_numbers.*", "offers")
    all_candidates = candidates.groupBy(page).agg(count_rows("candidates"))
    joined = counted.join(all_candidates.hint("merge"), page, "left").join(missing.hint("merge"), page, "left").fillna(0, ["candidates", "useful", "missing"])
    return joined.withColumn(
        "risk", coverage_risk(F.col("actionMarkers"), F.col("offers"), F.col("missing"), F.col("useful"), F.col(page) == 1)
    )


def extraction_stats(pages: DataFrame, offers: DataFrame, text: str = "text", page: str = "page_id") -> DataFrame:
    """Text length, offers, clean and suspect offers per page."""
    counts = offers.groupBy(page).agg(
        count_rows("offers"), F.count_if(~F.col("suspect")).alias("clean"), F.count_if("suspect").alias("suspect")
    )
    return pages.select(page, F.length(text).alias("textLength")).join(counts, page, "left").fillna(0, ["offers", "clean", "suspect"])


def image_coverage(pages: DataFrame, offers: DataFrame, image: str = "pageImageUrl", page: str = "pageNumber") -> DataFrame:
    """Pages with an image and the offers they cover."""
    counted = pages_with_counts(pages, offers, page)
    has = text_of(image) != ""
    return counted.agg(
        count_rows("pages"), F.count_if(has).alias("pagesWithImage"), F.sum("offers").alias("offers"),
        F.coalesce(F.sum(F.when(has, F.col("offers"))), F.lit(0)).alias("coveredOffers"),
    )


def index_coverage(offers: DataFrame, index: DataFrame, article: str = "klNr") -> DataFrame:
    """Index keys that offers use, and offers without a key."""
    used = offers.filter(text_of(article) != "").select(article).distinct()
    known = index.select(article).distinct()
    parts = [
        known.agg(count_rows("indexKeys")), used.agg(count_rows("usedKeys")),
        used.join(known, article, "left_semi").agg(count_rows("matchedKeys")),
        offers.agg(count_rows("offers"), F.count_if(text_of(article) == "").alias("offersWithoutKey")),
    ]
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return tagged.agg(*[F.max(c).alias(c) for c in ("indexKeys", "usedKeys", "matchedKeys", "offers", "offersWithoutKey")])


# --- checks and queries ------------------------------------------------------
def target_checks(pages: DataFrame, offers: DataFrame, checks: Sequence[tuple[str, str, int, float | None]], *,
                  text: str = "text", page: str = "pageNumber") -> DataFrame:
    """Status per check ``(label, query, expected page, expected price)``.

    Pages and offers are each scanned once; the check list is part of the plan.
    """
    pairs = [(label, query) for label, query, _, _ in checks]
    on_pages = match_checks(pages.select(page, text), normalize_search(text), pairs).groupBy("label").agg(count_rows("foundPages"))
    searchable = normalize_search(joined_text(offers))
    hits = match_checks(offers.select(page, "price", searchable.alias("_search")), F.col("_search"), pairs)
    prices = offers.sparkSession.createDataFrame(
        [(label, p, price) for label, _, p, price in checks if price is not None], "label string, _page int, _price double"
    )
    hits = hits.join(prices, "label", "left")
    wrong = (F.col(page) == F.col("_page")) & (F.abs(F.coalesce("price", F.lit(0.0)) - F.col("_price")) > rules.SAME_PRICE)
    in_offers = hits.groupBy("label").agg(count_rows("matches"), F.count_if(wrong).alias("priceProblems"))
    rows = offers.sparkSession.createDataFrame(
        [(label, query, p) for label, query, p, _ in checks], "label string, query string, expectedPage int"
    )
    joined = rows.join(on_pages, "label", "left").join(in_offers, "label", "left").fillna(0, ["foundPages", "matches", "priceProblems"])
    status = (
        F.when(F.col("foundPages") == 0, F.lit("missing-in-pdf-text"))
        .when(F.col("matches") == 0, F.lit("missing-in-current-offers"))
        .when(F.col("priceProblems") > 0, F.lit("price-mismatch"))
        .otherwise(F.lit("ok"))
    )
    return joined.withColumn("status", status)


def target_gaps(pages: DataFrame, offers: DataFrame, targets: Sequence[tuple[str, int, Sequence[str]]], *,
                text: str = "text", page: str = "pageNumber", radius: int = 650) -> DataFrame:
    """Per target ``(label, page, query variants)`` the best context, price and status.

    The first variant (in order) found on the expected page gives the context.
    """
    labels = [label for label, _, _ in targets]
    variants = [(f"{i}\u0001{v}", v) for i, (_, _, vs) in enumerate(targets) for v in vs]
    expected = {i: p for i, (_, p, _) in enumerate(targets)}
    on_page = F.lit(False)
    for i, p in expected.items():
        on_page = on_page | ((F.col("_target") == i) & (F.col(page) == p))
    hits = match_checks(
        offers.select(page, normalize_search(joined_text(offers, rules.PRODUCT_SEARCH_FIELDS)).alias("_search")), F.col("_search"), variants
    ).withColumn("_target", F.split("label", "\u0001")[0].cast("int"))
    matched = hits.filter(on_page).groupBy("_target").agg(count_rows("variantMatches"))

    tried = F.array(*[
        F.struct(F.lit(i).alias("t"), F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(v).alias("variant"))
        for i, (_, p, vs) in enumerate(targets) for k, v in enumerate(vs)
    ])
    here = F.filter(tried, lambda t: t["p"] == F.col(page))
    spots = pages.select(page, F.col(text).alias("_text"), F.explode(here).alias("_v")).withColumn(
        "_at", flexible_position("_text", normalize_search("_v.variant"))
    )
    found = spots.select("_v.*", F.when(F.col("_at") > 0, context_around("_text", F.col("_at"), radius)).alias("context"))
    best = found.filter("context is not null").groupBy("t").agg(
        F.min_by(F.struct("variant", "context"), F.col("k")).alias("_b")
    )
    priced = best.withColumn("price", M.pick_current_price(M.classify_price("_b.context")))
    rows = offers.sparkSession.createDataFrame([(i, label, expected[i]) for i, label in enumerate(labels)], "_target int, label string, expectedPage int")
    joined = rows.join(matched, "_target", "left").join(priced, rows["_target"] == priced["t"], "left")
    status = (
        F.when(F.coalesce("variantMatches", F.lit(0)) > 0, F.lit("already-in-current-offers"))
        .when(F.col("price").isNotNull(), F.lit("targeted-candidate-with-price"))
        .when(F.col("_b").isNotNull(), F.lit("targeted-candidate-needs-price-review"))
        .otherwise(F.lit("target-not-found"))
    )
    return joined.select("label", "expectedPage", F.col("_b.variant").alias("variant"), "price", F.col("_b.context").alias("context"), status.alias("status"))


def query_report(offers: DataFrame, checks: Sequence[tuple[str, str, int]], fields: Sequence[str] = rules.SEARCH_FIELDS) -> DataFrame:
    """Matches per ``(label, query, minimum)`` and whether they are too few."""
    counted = count_checks(offers, normalize_search(joined_text(offers, fields)), [(label, q) for label, q, _ in checks])
    least = F.create_map(*[F.lit(x) for label, _, n in checks for x in (label, n)])
    return counted.withColumn("minimum", least[F.col("label")]).withColumn("problem", F.col("matches") < F.col("minimum"))


def search_mode_comparison(offers: DataFrame, queries: Sequence[str], chain: str | None = None) -> DataFrame:
    """Matches per query in all fields, name + description, name only; of one ``chain`` if it is named."""
    if chain is not None:
        offers = offers.filter(Q.is_chain(chain, *[F.col(f) for f in rules.STORE_FIELDS if f in offers.columns]))
    modes = {
        "full": (*rules.SEARCH_FIELDS, "rawContext"),
        "productDescription": ("product", "name", "title", "description"),
        "productOnly": ("product", "name", "title"),
    }
    checks = [(q, q) for q in dict.fromkeys(queries)]
    found = offers.sparkSession.createDataFrame([(q,) for q, _ in checks], "query string")
    for mode, fields in modes.items():
        counts = count_checks(offers, normalize_search(joined_text(offers, fields)), checks)
        found = found.join(counts.select(F.col("label").alias("query"), F.col("matches").alias(mode)), "query")
    hidden = (F.col("full") > 0) & (F.col("productOnly") == 0)
    return found.withColumn(
        "diagnosis", F.when(hidden, F.lit("full-search-finds-results-but-product-only-does-not")).otherwise(F.lit("ok"))
    )


def import_reconciliation(source: DataFrame, combined: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected products in the source and in the combined table."""
    checks = [(e, e) for e in expected]
    left = count_checks(source, normalize_search(joined_text(source)), checks).withColumnRenamed("matches", "inSource")
    right = count_checks(combined, normalize_search(joined_text(combined)), checks).withColumnRenamed("matches", "inCombined")
    verdict = (
        F.when((F.col("inSource") > 0) & (F.col("inCombined") == 0), F.lit("lost-in-combine"))
        .when(F.col("inSource") == 0, F.lit("missing-in-source"))
        .otherwise(F.lit("ok"))
    )
    return left.join(right, "label").withColumn("diagnosis", verdict)


def coverage_by_file(offers: DataFrame, chain: str, terms: Sequence[str], file: str = "sourceFile") -> DataFrame:
    """Per source file all offers, the chain's offers, and those with a term."""
    fields = [F.col(f) for f in rules.STORE_FIELDS if f in offers.columns]
    any_term = F.exists(
        F.array(*[normalize_loose(F.lit(t)) for t in terms]), lambda t: F.contains(F.col("_t"), t)
    )
    marked = offers.select(F.col(file), Q.is_chain(chain, *fields).alias("_c"), normalize_loose(joined_text(offers)).alias("_t"))
    flagged = marked.select(file, "_c", any_term.alias("_h"))
    return flagged.groupBy(file).agg(
        count_rows("offers"), F.count_if("_c").alias("chainOffers"), F.count_if("_h").alias("termOffers"),
        F.count_if(F.col("_c") & F.col("_h")).alias("chainTermOffers"),
    )


def control_query_report(offers: DataFrame, candidates: DataFrame, checks: Sequence[tuple[str, str]]) -> DataFrame:
    """Matches among current offers and among new candidates."""
    current = count_checks(offers, normalize_search(joined_text(offers)), checks).withColumnRenamed("matches", "current")
    new = count_checks(candidates, normalize_search(joined_text(candidates)), checks).withColumnRenamed("matches", "candidates")
    return current.join(new, "label")


# --- noise -------------------------------------------------------------------
def noise_audit(offers: DataFrame, watched_pages: tuple[int, ...] = (20, 23, 35)) -> DataFrame:
    """Noisy offers with their findings and a recommendation."""
    price_text = F.col("priceText") if "priceText" in offers.columns else F.lit("")
    found = Q.noise_findings(F.col("product"), F.col("price"), price_text, F.col("category"), F.col("pageNumber"), watched_pages)
    audited = offers.withColumn("findings", found).filter(F.size("findings") > 0)
    return audited.withColumn("recommendation", Q.noise_recommendation(F.col("findings")))


def noise_totals(audited: DataFrame) -> DataFrame:
    """Findings per rule and severity."""
    flat = audited.select(F.inline("findings"))
    return flat.groupBy("id", "severity").agg(count_rows("offers"))


# --- text sources ------------------------------------------------------------
def text_sources(pages: DataFrame, html: str = "html", page: str = "page_id") -> DataFrame:
    """Every text a page hides: whole page, attributes, fragments, scripts."""
    from pricewren.functions.text import decode_url

    whole = F.array(F.struct(F.lit("full-html-decoded").alias("kind"), F.lit("").alias("name"), single_line(decode_url(H.decode_html(html))).alias("value")))
    attributes = F.transform(H.extract_attributes(html), lambda a: F.struct(F.lit("attribute").alias("kind"), a["name"].alias("name"), a["value"].alias("value")))
    fragments = F.transform(H.extract_percent_fragments(html), lambda f: F.struct(f["kind"].alias("kind"), F.lit("").alias("name"), f["value"].alias("value")))
    scripts = F.transform(H.extract_scripts(html), lambda s: F.struct(F.lit("script").alias("kind"), F.lit("").alias("name"), s.alias("value")))
    return pages.select(page, F.inline(F.concat(whole, attributes, fragments, scripts)))


def term_hits(sources: DataFrame, terms: Sequence[str], page: str = "page_id", radius: int = 350) -> DataFrame:
    """Distinct hits of a term list in text sources, with a snippet."""
    def fold(c):
        return F.lower(normalize_for_index(c))

    hits = match_checks(sources, fold("value"), [(t, t) for t in terms], normalize=normalize_for_index)
    return hits.select(page, "kind", "name", "label", snippet("value", F.col("label"), radius).alias("snippet")).distinct()


def terms_in_sources(sources: DataFrame, terms: DataFrame, *, source_id: str, value: str, term_id: str, term: str) -> DataFrame:
    """J9 for a term *table* of any size: (source, term) pairs."""
    folded = sources.select(source_id, normalize_for_index(value).alias("_v"))
    needles = terms.select(term_id, F.array(normalize_for_index(term)).alias("_parts"))
    return substring_join(folded, needles, text_id=source_id, text="_v", needle_id=term_id, parts="_parts")


def source_potential(pages: DataFrame, html: str = "html", page: str = "page_id", url: str = "url") -> DataFrame:
    """What a page offers to a parser, and a rating."""
    viewer = "(?iu)" + "|".join(rules.VIEWER_WORDS)
    pdf = r"(?i)\.pdf(?:[?#].*)?$"
    counted = pages.select(
        page,
        F.size(F.filter(H.extract_asset_urls(html), lambda u: u.rlike(pdf))).alias("pdfLinks"),
        F.size(F.filter(H.extract_links(html), lambda l: F.concat_ws(" ", l["href"], l["text"]).rlike(viewer))).alias("viewerLinks"),
        F.col(html).rlike(r"""(?i)<script[^>]+id=["']__NEXT_DATA__["']""").alias("hasNextData"),
        F.regexp_count(html, F.lit(r"""(?i)<script[^>]+type=["']application/ld\+json["']""")).alias("jsonLd"),
        F.size(H.endpoint_hints(html)).alias("endpoints"),
        F.size(F.filter(H.tag_lines(html), H.product_like)).alias("productLines"),
    )
    rating = (
        F.when(F.col("hasNextData") | (F.col("endpoints") > 5), F.lit("high-for-structured-data"))
        .when(F.col("pdfLinks") > 0, F.lit("medium-pdf-ocr-needed"))
        .when(F.col("viewerLinks") > 0, F.lit("medium-viewer-investigation-needed"))
        .when(F.col("productLines") > 10, F.lit("medium-html-parser-possible"))
        .otherwise(F.lit("low-or-needs-manual-investigation"))
    )
    return counted.withColumn("rating", rating)


def hidden_vs_visible(pages: DataFrame, terms: Sequence[str], html: str = "html", page: str = "page_id") -> DataFrame:
    """Prices, percents and terms in visible text against attribute text."""
    price = rf"{EDGE_L}\d{{1,4}}[,.]\d{{2}}{EDGE_R}|{EDGE_L}\d{{1,4}},-"
    percent = rf"{EDGE_L}\d{{1,3}}\s*%"
    texts = pages.select(page, H.strip_tags(html).alias("visible"), H.extract_meta_text(html).alias("hidden"))
    known = F.array(*[normalize_for_index(F.lit(t)) for t in terms])

    def hits(text: str) -> Column:
        return let(normalize_for_index(text), lambda v: F.filter(known, lambda t: F.contains(v, t)))

    counted = texts.select(
        page,
        *[F.regexp_count(side, F.lit(price)).alias(f"{side}Prices") for side in ("visible", "hidden")],
        *[F.regexp_count(side, F.lit(percent)).alias(f"{side}Percents") for side in ("visible", "hidden")],
        F.size(F.array_except(hits("hidden"), hits("visible"))).alias("hiddenOnlyTerms"),
    )
    useful = (
        (F.col("hiddenPrices") >= F.greatest(F.lit(4), F.col("visiblePrices") + 4)) | (F.col("hiddenOnlyTerms") >= 3)
        | (F.col("hiddenPercents") >= F.greatest(F.lit(4), F.col("visiblePercents") + 3))
    )
    return counted.withColumn("useful", useful)


def nearest_images(pages: DataFrame, offers: DataFrame, html: str = "html", page: str = "page_id", url: str = "url", k: int = 2) -> DataFrame:
    """The images closest to the first long word of a product on its page.

    The words (the first five long ones, as the definition has it) are looked up beside
    the page, distinct per page and in one scan; what meets the offers are positions of
    words and images, no text.
    """
    tag = rf"(?is)<img{EDGE_R}[^>]*>"
    source = r"""(?i)\s(?:src|data-src|data-original)\s*=\s*["']([^"']+)["']"""
    images = F.filter(
        F.transform(H.match_positions(html, tag), lambda m: F.struct(m["pos"].alias("pos"), F.regexp_extract(m["match"], source, 1).alias("src"))),
        lambda i: i["src"] != "",
    )
    tokens = F.slice(F.filter(F.split(normalize_search("product"), " "), lambda t: F.length(t) >= 4), 1, 5)
    wanted = offers.select(page, F.explode(F.array_distinct(tokens)).alias("_token")).distinct().select(
        page, "_token", F.concat_ws("\u0001", F.col(page).cast("string"), "_token").alias("_needle"), F.array("_token").alias("_parts")
    )
    texts = pages.select(page, normalize_for_index(H.decode_html(html)).alias("_text"))
    places = substring_join(
        texts, wanted, text_id=page, text="_text", needle_id="_needle", parts="_parts", on=[page],
        derive=lambda text, parts: [parts[0].alias("_token"), (F.instr(text, parts[0]) - 1).alias("_pos")],
    ).select(F.col(page).alias("_of"), "_token", "_pos")
    columns = F.struct(*offers.columns)
    numbered = offers.withColumn("_row", F.monotonically_increasing_id())
    words = numbered.select("_row", columns.alias("_offer"), F.col(page).alias("_page"), F.explode(F.array_distinct(tokens)).alias("_word"))
    # Positions and images grow with the pages: neither side is broadcast, whatever its estimate.
    placed = words.join(places.hint("merge"), (F.col("_page") == F.col("_of")) & (F.col("_word") == F.col("_token"))).groupBy("_row").agg(
        F.min("_pos").alias("_at"), F.first("_offer").alias("_offer"), F.first("_page").alias("_page")
    )
    spots = pages.select(F.col(page).alias("_of"), F.col(url).alias("_url"), images.alias("_images")).filter(F.size("_images") > 0)
    ranked = F.slice(F.array_sort(F.transform(
        "_images", lambda i, n: F.struct(F.abs(i["pos"] - F.col("_at")).alias("distance"), n.alias("n"), i["src"].alias("src"))
    )), 1, k)
    near = placed.join(spots.hint("merge"), F.col("_page") == F.col("_of")).select("_offer.*", "_url", F.explode(ranked).alias("_i"))
    address = H.resolve_url("_i.src", F.col("_url"))
    return near.select(*offers.columns, address.alias("imageUrl"), F.col("_i.distance").alias("distance")).withColumn(
        "imageClass", H.classify_image("imageUrl")
    )
