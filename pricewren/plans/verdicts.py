"""Verdicts of the audits: what the counts of D8, D13-D16, D19, D22 and D23 mean, and why a row was lost.

Every verdict is one row per group (``by``: a chain, a source, a list), so a report over
many chains is one aggregation; nothing is compared row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pricewren import rules
from pricewren.functions import html as H, quality as Q
from pricewren.functions.quality import is_marketing
from pricewren.functions.text import normalize_search, not_blank
from pricewren.operators.dedupe import offer_key, union_sources
from pricewren.operators.enrich import enrich_offer, joined_text, normalize_offer
from pricewren.operators.lines import top_k_per_group
from pricewren.operators.match import match_checks, match_expected, telling_words
from pricewren.plans.audit import count_rows, exact_key, noise_audit
from pricewren.session import staged


def _first_case(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    label = F.lit(otherwise)
    for condition, name in reversed(cases):
        label = F.when(condition, F.lit(name)).otherwise(label)
    return label


def of_chain(offers: DataFrame, chain: str) -> Column:
    """Q9 over the store fields that the offers have."""
    return Q.is_chain(chain, *[F.col(f) for f in rules.STORE_FIELDS if f in offers.columns])


# --- D8: noise ----------------------------------------------------------------
def noise_summary(offers: DataFrame, by: Sequence[str] = (), watched_pages: tuple[int, ...] = (20, 23, 35)) -> DataFrame:
    """Per group the noisy offers by what to do with them, the duplicate groups and the recommended path."""
    whole = not by
    by, offers = (["_all"], offers.withColumn("_all", F.lit(1))) if whole else (list(by), offers)
    audited = noise_audit(offers, watched_pages)
    is_ = lambda label: F.count_if(F.col("recommendation") == label)
    noisy = audited.groupBy(*by).agg(
        count_rows("noisyOffers"), F.count_if(F.exists("findings", lambda f: f["severity"] == "high")).alias("highRiskOffers"),
        is_("candidate-remove-or-replace-with-clean-existing").alias("removeCandidates"), is_("candidate-fix-fields").alias("fixFieldCandidates"),
    )
    exact = offers.groupBy(*by, *exact_key()).agg(count_rows("n")).filter("n > 1").groupBy(*by).agg(count_rows("exactDuplicateGroups"))
    keyed = offers.select(*by, F.col("pageNumber").alias("_page"), Q.near_duplicate_key(F.col("product")).alias("_name")).filter("_name is not null")
    near = keyed.groupBy(*by, "_page", "_name").agg(count_rows("n")).filter("n > 1").groupBy(*by).agg(count_rows("nearDuplicateGroups"))
    out = offers.groupBy(*by).agg(count_rows("totalOffers"))
    for part in (noisy, exact, near):
        out = out.join(part, by, "left")
    numbers = [c for c in out.columns if c not in by]
    path = _first_case(
        (F.col("removeCandidates") > 0, "inspect-remove-candidates-then-build-cleanup-patch"),
        (F.col("fixFieldCandidates") > 0, "build-field-fix-patch"), otherwise="no-critical-noise-found",
    )
    out = out.fillna(0, numbers).withColumn("recommendedPath", path)
    return out.drop("_all") if whole else out


# --- D13: queries and pages -----------------------------------------------------
def page_minimums(offers: DataFrame, minimums: Sequence[tuple[int, int]], page: str = "pageNumber") -> DataFrame:
    """Offers of each important page against its minimum; pages without offers are included."""
    wanted = offers.sparkSession.createDataFrame([(p, n) for p, n in minimums], "page long, minimum long")
    counted = offers.filter(F.col(page).isin([p for p, _ in minimums])).groupBy(F.col(page).cast("long").alias("page")).agg(count_rows("offers"))
    joined = wanted.join(counted, "page", "left").withColumn("offers", F.coalesce("offers", F.lit(0)))
    return joined.withColumn("problem", F.col("offers") < F.col("minimum"))


def query_samples(offers: DataFrame, checks: Sequence[tuple[str, str]], *order: Column | str, k: int = 20) -> DataFrame:
    """The first ``k`` offers of each ``(label, query)``, with their rank."""
    hits = match_checks(offers, normalize_search(joined_text(offers)), checks)
    return top_k_per_group(hits, ["label"], k, *order)


# --- D14: search modes ----------------------------------------------------------
def search_verdicts(comparison: DataFrame, main: str | None = None, pair: tuple[str, str] | None = None) -> DataFrame:
    """``(query, problem)`` of a search mode comparison.

    A query that only metadata answers is a problem, of its own kind for the ``main``
    term; where both queries of ``pair`` have results, the data are fine.
    """
    hidden = (F.col("full") > 0) & (F.col("productOnly") == 0)
    folded = normalize_search("query")
    kinds = [F.when(hidden, F.lit("full-search-finds-results-but-product-only-does-not"))]
    if main is not None:
        kinds.append(F.when(hidden & (folded == normalize_search(F.lit(main))), F.lit(f"{main}-only-in-metadata")))
    found = comparison.select("query", F.explode(F.array_compact(F.array(*kinds))).alias("problem"))
    if pair is None:
        return found
    a, b = (F.count_if((folded == normalize_search(F.lit(q))) & (F.col("full") > 0)) > 0 for q in pair)
    both = comparison.agg((a & b).alias("ok")).filter("ok").select(F.lit("/".join(pair)).alias("query"), F.lit("data-search-ok").alias("problem"))
    return found.unionByName(both)


# --- D15: imports ---------------------------------------------------------------
def import_problems(source: DataFrame, combined: DataFrame, by: Sequence[str], *, term: str, product: str, added: DataFrame | None = None,
                    many: int = 5, few: int = 2) -> DataFrame:
    """Problems of an import, one row per group and problem.

    ``term`` is the search term of the imported category, ``product`` a product that
    should be in it.  ``added`` (``by`` and ``added``) is what the import reported.
    """
    by = list(by)

    def counted(df: DataFrame, name: str) -> DataFrame:
        text = normalize_search(joined_text(df))
        has_term, has_product = F.contains(text, normalize_search(F.lit(term))), F.contains(text, normalize_search(F.lit(product)))
        marked = df.select(*by, has_term.alias("_t"), has_product.alias("_p"))
        return marked.groupBy(*by).agg(
            F.count_if("_t").alias(f"{name}Term"), F.count_if("_p").alias(f"{name}Product"), F.count_if(F.col("_t") & F.col("_p")).alias(f"{name}Both"),
        )

    joined = counted(source, "source").join(counted(combined, "combined"), by, "full")
    joined = joined.join(added, by, "left") if added is not None else joined.withColumn("added", F.lit(0))
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("sourceTerm", "sourceProduct", "combinedTerm", "combinedProduct", "combinedBoth", "added")}
    problems = [
        ((n["sourceTerm"] > many) & (n["combinedTerm"] <= few), "in-source-not-in-combined"),
        (n["sourceTerm"] <= few, "missing-in-source"),
        ((n["sourceProduct"] > 0) & (n["combinedProduct"] == 0), "product-lost"),
        ((n["combinedProduct"] > 0) & (n["combinedBoth"] == 0), "product-without-search-term"),
        ((n["added"] > 0) & (n["sourceTerm"] <= few), "reported-added-but-absent"),
    ]
    return joined.select(*by, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in problems]))).alias("problem"))


def traced_sources(sources: Mapping[str, DataFrame], order: Sequence[str] = ("sourceOrder", "seq")) -> DataFrame:
    """Every source row with ``fate``: kept, or why the combined table doesn't have it.

    ``no-price``, ``suspect``, ``no-product`` and ``marketing`` follow the filters of the
    combine plan; ``replaced`` rows name the copy that won in ``replacedBy`` (id) and
    ``replacedFrom`` (source).  Winners are one row per key before they are joined back, so a
    key with many copies is a join that Spark can split.
    """
    prepared = []
    for position, (name, df) in enumerate(sources.items()):
        rows = enrich_offer(normalize_offer(df, name)).withColumn("sourceOrder", F.lit(position))
        prepared.append(rows)
    rows = union_sources(*prepared)
    fate = (
        F.when(F.col("price").isNull(), F.lit("no-price")).when(F.coalesce("suspect", F.lit(False)), F.lit("suspect"))
        .when(F.col("product") == "", F.lit("no-product")).when(is_marketing(F.col("product"), F.col("description"), F.col("rawContext")), F.lit("marketing"))
    )
    place, places = F.struct(*order), [F.col(f"_place.{o}").alias(o) for o in order if o not in ("id", "sourceFile")]
    # The key travels as 128 bits of hash; nulls are told apart from missing columns.
    parts = [c for k in offer_key() for c in (k.isNull(), k)]
    key = F.struct(F.xxhash64(F.lit(0), *parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))
    judged = staged(rows.select("sourceFile", "id", place.alias("_place"), key.alias("_key"), fate.alias("_lost")), "traced")
    winners = staged(judged.filter("_lost is null").groupBy("_key").agg(
        F.max(F.struct("_place", "id", "sourceFile")).alias("_winner")
    ).withColumnRenamed("_key", "_of"), "winners")
    passed = judged.filter("_lost is null").join(winners, F.col("_key") == F.col("_of"))
    won = F.col("_place") == F.col("_winner._place")
    decided = passed.select(
        "sourceFile", "id", *places, F.when(won, F.lit("kept")).otherwise(F.lit("replaced")).alias("fate"),
        F.when(~won, F.col("_winner.id")).alias("replacedBy"), F.when(~won, F.col("_winner.sourceFile")).alias("replacedFrom"),
    )
    none = F.lit(None).cast("string")
    dropped = judged.filter("_lost is not null").select(
        "sourceFile", "id", *places, F.col("_lost").alias("fate"), none.alias("replacedBy"), none.alias("replacedFrom")
    )
    return decided.unionByName(dropped)


def lost_rows(sources: Mapping[str, DataFrame], order: Sequence[str] = ("sourceOrder", "seq")) -> DataFrame:
    """One row per source row that the combined table lacks, with the reason."""
    return traced_sources(sources, order).filter("fate <> 'kept'")


def reconcile_tables(before: DataFrame, after: DataFrame, key: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Full outer compare by a unique key: ``status`` (same, changed, lost, new) and the names of changed columns."""
    key, compare = list(key), list(compare)
    left = before.select(*key, F.struct(*compare).alias("_a"), F.lit(True).alias("_l"))
    right = after.select(*key, F.struct(*compare).alias("_b"), F.lit(True).alias("_r"))
    joined = left.join(right, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.equal_null(F.col(f"_a.{c}"), F.col(f"_b.{c}")), F.lit(c)) for c in compare]))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    out = joined.withColumn("changed", F.when(both, changed).otherwise(F.array().cast("array<string>")))
    status = _first_case((F.col("_r").isNull(), "lost"), (F.col("_l").isNull(), "new"), (F.size("changed") > 0, "changed"), otherwise="same")
    return out.select(*key, status.alias("status"), "changed")


# --- D16: expected products -------------------------------------------------------
def expected_report(offers: DataFrame, chain: str, terms: Sequence[str], expected: DataFrame, name: str = "expected") -> DataFrame:
    """For each expected product its offers in the chain, in the chain's offers with a term, and in all data.

    ``expected`` is a table with the column ``name``.  Texts are cut down to the words that matter to
    some expected product (``match.telling_words``) before they are counted and matched, as most offers differ only in
    others; the counting starts in the map tasks, so what moves grows with the products, not with the offers.
    """
    listed = F.transform(F.lit(list(terms)).cast("array<string>"), normalize_search)
    wanted = expected.select(name).distinct().withColumn("_e", F.col(name))
    texts = staged(offers.select(normalize_search(joined_text(offers)).alias("_full"), of_chain(offers, chain).alias("_chain")), "texts")
    cut = telling_words(texts, "_full", wanted, name).select(F.col("_telling").alias("_text"), "_chain", F.exists(listed, lambda t: F.contains("_full", t)).alias("_term"))
    counted = cut.groupBy("_text", "_chain", "_term").agg(count_rows("_n"))
    pairs = match_expected(counted, wanted, text_id="_n", text="_text", term_id="_e", term=name, carry=["_chain", "_term"])
    wanted = wanted.select(name)
    found = pairs.groupBy("_e").agg(
        F.sum(F.when(F.col("_chain"), F.col("_n"))).alias("foundInChain"), F.sum(F.when(F.col("_chain") & F.col("_term"), F.col("_n"))).alias("foundInSubset"),
        F.sum("_n").alias("foundInAll"),
    )
    return wanted.join(found, F.col(name) == F.col("_e"), "left").drop("_e").fillna(0, ["foundInChain", "foundInSubset", "foundInAll"])


def likely_problem(report: DataFrame, by: Sequence[str] = (), many: int = 5) -> DataFrame:
    """What the expected products of each list point to."""
    missing = F.count_if(F.col("foundInChain") == 0)
    problem = _first_case(
        (F.count_if((F.col("foundInAll") > 0) & (F.col("foundInChain") == 0)) > 0, "combine-or-store-tagging-problem"),
        (missing > many, "import-missing-page-items"), otherwise="search-context-or-filter-problem",
    )
    return report.groupBy(*by).agg(count_rows("expectedProducts"), missing.alias("missingInChain"), problem.alias("likelyProblem"))


# --- D19: sources -----------------------------------------------------------------
def source_next_steps(potential: DataFrame, ok: Column | None = None) -> DataFrame:
    """The next step for each probed source, and its rank (1 is the most promising)."""
    loaded = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    steps = (
        (~loaded, "repair-page-loading", 6), (F.col("hasNextData"), "parse-next-data", 1), (F.col("endpoints") > 0, "probe-endpoints", 2),
        (F.col("pdfLinks") > 0, "read-pdf-text", 3), (F.col("viewerLinks") > 0, "open-viewer-links", 4),
    )
    step, rank = F.lit("manual-review"), F.lit(5)
    for condition, label, number in reversed(steps):
        step, rank = F.when(condition, F.lit(label)).otherwise(step), F.when(condition, F.lit(number)).otherwise(rank)
    return potential.withColumns({"nextStep": step, "stepRank": rank})


# --- D22: images ------------------------------------------------------------------
def image_paths(offers: DataFrame, images: DataFrame, nearby: DataFrame, by: str = "chain", url: str = "imageUrl",
                fields: Sequence[str] = rules.IMAGE_FIELDS, leaflet_words: tuple[str, ...] = ()) -> DataFrame:
    """Per chain the images by class and the way to product images.

    ``images`` are the addresses found on a chain's pages, ``nearby`` those next to a product.
    """
    filled = [not_blank(f).isNotNull() for f in fields if f in offers.columns]
    any_field = F.lit(False)
    for f in filled:
        any_field = any_field | f
    kind = H.classify_image(url, leaflet_words)
    of = lambda label: F.count_if(F.col("_kind") == label)
    own = offers.groupBy(by).agg(count_rows("offers"), F.count_if(any_field).alias("existingImageFields"))
    seen = images.select(by, url).distinct().withColumn("_kind", kind).groupBy(by).agg(
        count_rows("testedImages"), of("possible-product-image").alias("possibleProductImages"), of("page-or-leaflet-image").alias("pageOrLeafletImages"),
        of("decorative-or-cover").alias("decorativeOrCoverImages"),
    )
    near = nearby.withColumn("_kind", kind).groupBy(by).agg(of("possible-product-image").alias("nearbyProductCandidates"))
    out = own.join(seen, by, "full").join(near, by, "full")
    out = out.fillna(0, [c for c in out.columns if c != by])
    path = _first_case(
        (F.col("existingImageFields") > 0, "use-existing-offer-image-fields"),
        ((F.col("possibleProductImages") > 0) | (F.col("nearbyProductCandidates") > 0), "map-product-images-from-html"),
        (F.col("pageOrLeafletImages") > 0, "page-image-crops-or-no-product-images"), otherwise="no-direct-product-images-found",
    )
    return out.withColumn("recommendedPath", path)


# --- D23: stores ------------------------------------------------------------------
def store_endpoints(html: Column | str, base: Column | str) -> Column:
    """Distinct quoted strings that look like a store's data addresses, under 300 characters; rooted ones are resolved."""
    short = F.filter(H.endpoint_hints(html, rules.STORE_ENDPOINT_WORDS), lambda v: F.length(v) < 300)
    return F.array_distinct(F.transform(short, lambda v: F.when(F.startswith(v, F.lit("/")), H.resolve_url(v, base)).otherwise(v)))


def leaflet_links(html: Column | str, words: Sequence[str] = rules.LEAFLET_LINK_WORDS) -> Column:
    """Links whose address or text names a leaflet."""
    return F.filter(H.extract_links(html), lambda a: F.exists(
        F.lit(list(words)), lambda w: F.contains(F.lower(F.concat_ws(" ", a["href"], a["text"])), w)
    ))
