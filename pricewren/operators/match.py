"""Joins (rows J1, J2, J5-J11 of the inventory), including substring joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pricewren.functions.text import let, normalize_search, not_blank, text_of
from pricewren.session import staged

#: Gram lengths; a needle is found by the longest that its longest part can fill.
SIZES = (8, 4, 2, 1)
#: Most bits of a table of grams, as a power of two: 256 KB however many needles there are.
BITS = 21
#: The same where the table is read in place and not copied with the rows: 8 MB, so that few grams pass that are no anchor's.
WIDE_BITS = 26
#: Places of the table that counts how often a needle has a gram, as a power of two.
COUNT_BITS = 17
#: Needles that a join may broadcast; more are sorted and merged, as the estimate of a derived table says nothing of its rows.
BROADCAST_NEEDLES = 100_000


def grams(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters in order (one linear pass)."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _of_size(size: Column, value) -> Column:
    """``value(n)`` for the one ``n`` of SIZES that ``size`` is."""
    out = F.lit(None)
    for n in SIZES:
        out = F.when(size == n, value(n)).otherwise(out)
    return out


def bits_for(grams: int, most: int = BITS) -> int:
    """Bits of a table for so many grams: 64 a gram as far as the bound allows, since a table may be copied with every row."""
    return min(most, max(10, (64 * grams).bit_length()))


def _places(gram: Column, bits: int = BITS) -> list[Column]:
    """Two places in the bit table."""
    hashed = F.xxhash64(gram)
    return [hashed.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftright(hashed, 32).bitwiseAND(F.lit((1 << bits) - 1))]


def anchor_index(needles: DataFrame, *, needle_id: str, parts: str, on: Sequence[str] = ()) -> DataFrame:
    """One row per needle with its anchor, the gram that finds it: ``_gram``, ``_size``, ``_part``, ``_offset``, and its ``_parts``.

    The anchor is the gram of the needle that fewest needles have, with the part it
    comes from and its 0-based place there.  Needles are read only; empty parts are
    ignored and needles without parts are left out.  How many needles have a gram is counted
    in a table of hashed grams of fixed size, which each needle reads in place: neither
    needles nor their grams are shuffled.  Grams that share a place count as one, which may
    cost a better anchor, but no match.
    """
    on = list(on)
    rows = _apart(needles, *on, needle_id, F.filter(parts, lambda p: p != "").alias("_parts"))
    place = lambda g: F.xxhash64(g).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))

    def size_of(own: Column) -> Column:
        longest = F.array_max(F.transform(own, F.length))
        size = F.lit(SIZES[-1])
        for n in reversed(SIZES):
            size = F.when(longest >= n, F.lit(n)).otherwise(size)
        return size

    of_part = lambda p, size: _of_size(size, lambda n: grams(p, n))
    own_grams = let(size_of(F.col("_parts")), lambda size: F.array_distinct(F.flatten(F.transform("_parts", lambda p: of_part(p, size)))))
    placed = rows.select(F.transform(own_grams, place).alias("_places")).select(F.explode_outer("_places").alias("word")).filter("word is not null")
    table = _dense(placed.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "n", 1 << COUNT_BITS)

    def best(counts: Column, size: Column) -> Column:
        def of(p: Column, part: Column) -> Column:
            return F.transform(of_part(p, size), lambda g, at: F.struct(
                F.get(counts, place(g).cast("int")).alias("_needles"), F.xxhash64(g).alias("h"), part.alias("_part"), at.alias("_offset"),
                g.alias("_gram"), size.alias("_size"),
            ))

        return F.array_min(F.flatten(F.transform("_parts", of)))

    anchor = let(F.col("_counts"), lambda counts: let(size_of(F.col("_parts")), lambda size: F.array(best(counts, size))))
    chosen = rows.withColumn("_counts", table.scalar()).select(*on, needle_id, "_parts", anchor.alias("_best"))
    chosen = chosen.select(*on, needle_id, "_parts", F.explode_outer("_best").alias("_best")).filter("_best is not null")
    return chosen.select(*on, needle_id, *[F.col(f"_best.{c}").alias(c) for c in ("_gram", "_size", "_part", "_offset")], "_parts")


def _apart(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns behind a generator of one row.

    A table added to them as one value is then always merged into the projection that uses it
    once; with columns that are derived in the same step it might be copied with every row instead.
    """
    return df.select(F.explode_outer(F.array(F.struct(*columns))).alias("_row")).select("_row.*")


def _dense(words: DataFrame, value: str, size: int) -> DataFrame:
    """One array of ``size`` values from rows of ``word`` and a value, 0 where there is none."""
    every = words.sparkSession.range(size).withColumnRenamed("id", "word").join(words, "word", "left")
    listed = F.array_sort(F.collect_list(F.struct("word", F.coalesce(value, F.lit(0)).alias("value"))))
    return every.agg(F.transform(listed, lambda w: w["value"]).alias("values"))


def bit_table(anchors: DataFrame, size: int = BITS) -> Column:
    """The anchors' bits and gram lengths as one value for all rows: ``struct(bits, sizes)``, of ``2**size`` bits."""
    bits = anchors.select(F.explode(F.array(*_places(F.col("_gram"), size))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    dense = _dense(bits, "bits", 1 << (size - 6))
    sizes = anchors.agg(F.collect_set("_size").alias("sizes"))
    return F.struct(dense.scalar().alias("bits"), sizes.scalar().alias("sizes"))


def in_bit_table(gram: Column, bits: Column, size: int = BITS) -> Column:
    """Whether a gram may be an anchor: never wrong for one that is."""
    def test(at: Column) -> Column:
        return F.call_function("getbit", F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    first, second = _places(gram, size)
    return test(first) & test(second)


def substring_join(texts: DataFrame, needles: DataFrame, *, text_id: str, text: str, needle_id: str, parts: str,
                   on: Sequence[str] = (), carry: Sequence[str] = (), derive=None) -> DataFrame:
    """All pairs ``(text_id, needle_id)`` where every part occurs in the text.

    Exact "contains" join between two tables of any size, in one scan of the texts.
    Each needle has an anchor gram (``anchor_index``).  A bit table of all anchors, of
    fixed size, goes to every row; the text's grams are looked up in it inside the row,
    and only the few that hit leave it, with the text.  An equi join of these on the
    gram finds the needles, and ``contains`` verifies them.  No text is joined, sorted
    or read twice; a text moves only if the anchors are too many to be broadcast (they
    are counted), once a hit.  ``on`` names equi-join columns both sides share (e.g. the page), ``carry``
    further columns of the texts to keep, ``derive(text, parts)`` columns made from a
    hit.  Needle ids must be unique; empty parts are ignored and needles without parts
    match nothing.
    """
    on, keys = list(on), [*on, "_gram"]
    anchors = staged(anchor_index(needles, needle_id=needle_id, parts=parts, on=on), "anchors")
    counts = anchors.agg(F.count(F.lit(1)).alias("needles"), F.count_distinct("_gram").alias("grams")).first()
    sorted_join = (lambda df: df.hint("merge")) if counts["needles"] > BROADCAST_NEEDLES else (lambda df: df)
    bits = bits_for(counts["grams"], WIDE_BITS)
    found = anchors.select(*keys, F.col(needle_id).alias("_needle"), "_parts")

    def every(table: Column) -> Column:
        kept = lambda n: F.filter(grams(F.col("_text"), n), lambda g: in_bit_table(g, table["bits"], bits))
        return F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(F.array_contains(table["sizes"], n), kept(n)) for n in SIZES]))))

    columns = list(dict.fromkeys([*on, text_id, *carry]))
    rows = _apart(texts, *columns, F.col(text).alias("_text")).withColumn("_table", bit_table(anchors, bits))
    rows = rows.select(*columns, "_text", let(F.col("_table"), every).alias("_grams"))
    hits = rows.select(*columns, "_text", F.explode_outer("_grams").alias("_gram"))
    pairs = hits.join(sorted_join(found), keys).filter(F.forall("_parts", lambda p: F.contains(F.col("_text"), p)))
    extra = derive(F.col("_text"), F.col("_parts")) if derive else []
    return pairs.select(text_id, F.col("_needle").alias(needle_id), *[c for c in carry if c != text_id], *extra)


def match_checks(df: DataFrame, text: Column, checks: Sequence[tuple[str, str]], normalize=normalize_search) -> DataFrame:
    """J7 / J8 for a check list of any length: one row per (row, matching check label).

    ``text`` must already be normalised.  The list is two literal arrays of the
    plan, labels and queries, so the plan has the same shape for every length and
    there is no join at all; tables of checks use substring_join.
    """
    return (
        df.withColumn("_text", text)
        .withColumn("label", F.explode(_matching(F.col("_text"), checks, normalize, lambda i: F.get(F.lit([c[0] for c in checks]), i))))
        .drop("_text")
    )


def _matching(text: Column, checks: Sequence[tuple[str, str]], normalize, value) -> Column:
    """``value(i)`` of every check ``i`` whose query the text contains."""
    if not checks:
        return F.array().cast("array<string>")
    queries = F.transform(F.lit([query for _, query in checks]), normalize)
    hits = F.transform(queries, lambda q, i: F.when(F.contains(text, q), i))
    return F.transform(F.array_compact(hits), value)


def count_checks(df: DataFrame, text: Column, checks: Sequence[tuple[str, str]], normalize=normalize_search) -> DataFrame:
    """Matches per check, checks without a match included."""
    hits = df.select(text.alias("_text")).select(F.explode(_matching(F.col("_text"), checks, normalize, lambda i: i)).alias("check"))
    counted = hits.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    rows = df.sparkSession.createDataFrame([(i, label) for i, (label, _) in enumerate(checks)], "check int, label string")
    return rows.join(counted, "check", "left").select("label", F.coalesce("n", F.lit(0)).alias("matches"))


def words_of(term: Column, shortest: int = 3) -> Column:
    return F.filter(F.split(term, " "), lambda w: F.length(w) >= shortest)


def match_expected(texts: DataFrame, expected: DataFrame, *, text_id: str, text: str, term_id: str, term: str,
                   shortest: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs where the expected term, or all its longer words, occur.

    When the whole term occurs so do its words, hence the words alone decide
    whenever there is one; only terms made of short words need the phrase.
    """
    needles = _expected_parts(expected, term_id, term, shortest)
    return substring_join(texts, needles, text_id=text_id, text=text, needle_id=term_id, parts="_needles", carry=carry)


def _expected_parts(expected: DataFrame, term_id: str, term: str, shortest: int = 3) -> DataFrame:
    """``_needles``, what of an expected term must occur: its longer words, else the whole term."""
    folded = expected.select(term_id, normalize_search(term).alias("_term"))
    words = words_of(F.col("_term"), shortest)
    return folded.select(term_id, F.when(F.size(words) > 0, words).otherwise(F.array("_term")).alias("_needles"))


def telling_words(texts: DataFrame, text: str, expected: DataFrame, term: str, shortest: int = 3) -> DataFrame:
    """``texts`` with ``_telling``: the words of a folded text that decide which expected terms occur in it (J7), once each.

    A part without blanks occurs in a text when it occurs in one of its words, so the distinct words of
    all texts are matched with the parts.  The words that hold one are known to every row by a bit
    table; a few others may pass it, which changes no match.  Where some term is a phrase of short words, whole texts are kept.
    """
    parts = _expected_parts(expected, term, term, shortest).select(F.explode("_needles").alias("_sought")).filter("_sought <> ''").distinct()
    parts = staged(parts.withColumn("_seek", F.array("_sought")), "parts")
    if parts.filter(F.contains("_sought", F.lit(" "))).limit(1).count():
        return texts.withColumn("_telling", F.col(text))
    words = texts.select(F.explode(F.split(text, " ")).alias("_word")).distinct()
    held = staged(substring_join(words, parts, text_id="_word", text="_word", needle_id="_sought", parts="_seek").select(
        F.col("_word").alias("_gram"), F.lit(0).alias("_size")).distinct(), "words")
    bits = bits_for(held.count())
    kept = F.filter(F.array_distinct(F.split(text, " ")), lambda w: in_bit_table(w, F.col("_table.bits"), bits))
    return texts.withColumn("_table", bit_table(held, bits)).withColumn("_telling", F.array_join(kept, " ")).drop("_table")


# --- validity and catalog ----------------------------------------------------
def attach_validity(offers: DataFrame, index: DataFrame, order: str, article: str = "klNr", row_id: str = "id") -> DataFrame:
    """Dates of the article; the first dated index row is the fallback.

    Offers without an article number get a private, never matching join key, so
    they spread over all partitions instead of meeting in one.
    """
    dates = index.groupBy(article).agg(
        F.max_by(F.struct("dateFrom", "dateTo"), order).alias("_dates")
    ).withColumnRenamed(article, "_article")
    dated = index.filter((text_of("dateFrom") != "") | (text_of("dateTo") != ""))
    fallback = dated.agg(F.min_by(F.struct("dateFrom", "dateTo"), order).alias("f")).select("f")
    key = F.coalesce(not_blank(article), F.concat(F.lit("\u0000"), text_of(row_id)))
    joined = offers.withColumn("_key", key).join(dates, F.col("_key") == F.col("_article"), "left")
    return (
        joined.withColumn("_dates", F.coalesce("_dates", fallback.scalar()))
        .withColumns({"validFrom": text_of("_dates.dateFrom"), "validTo": text_of("_dates.dateTo")})
        .drop("_key", "_article", "_dates")
    )


def join_stores(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """Offers with their store's catalog columns."""
    named = stores.select(F.col("id").alias("storeId"), *[F.col(c).alias(f"store_{c}") for c in stores.columns if c != "id"])
    return offers.join(named, "storeId")


# --- presence of candidates --------------------------------------------------
def _named(df: DataFrame, page: str, **columns: Column) -> DataFrame:
    """Distinct folded texts per page, each with a key of 128 bits."""
    picked = df.select(F.col(page).alias("page"), *[c.alias(n) for n, c in columns.items()]).distinct()
    return picked.withColumn("key", F.unhex(F.md5(F.concat_ws("\u0001", F.col("page").cast("string"), *columns).cast("binary"))))


def matches_existing(candidates: DataFrame, offers: DataFrame, offer_text: Column, page: str = "pageNumber") -> DataFrame:
    """Distinct (page, name) of candidates an offer of the same page covers.

    Covered: the offer's text contains the candidate's name, or the candidate's
    name contains the offer's name.  Both directions are substring joins.
    """
    wanted = _named(candidates.filter(normalize_search("product") != ""), page, name=normalize_search("product"))
    known = _named(offers, page, text=offer_text)
    names = _named(offers.filter(normalize_search("product") != ""), page, name=normalize_search("product"))
    needles = wanted.select("page", F.col("key").alias("needle"), F.array("name").alias("parts"))
    forward = substring_join(known, needles, text_id="key", text="text", needle_id="needle", parts="parts", on=["page"])
    inner = names.select("page", F.col("key").alias("needle"), F.array("name").alias("parts"))
    backward = substring_join(wanted, inner, text_id="key", text="name", needle_id="needle", parts="parts", on=["page"])
    covered = forward.select(F.col("needle").alias("key")).union(backward.select("key")).distinct()
    return wanted.join(covered.hint("merge"), "key", "left_semi").select("page", "name")


def split_by_existing(candidates: DataFrame, offers: DataFrame, offer_text: Column, page: str = "pageNumber") -> DataFrame:
    """Candidates with ``existing`` telling whether an offer covers them."""
    covered = matches_existing(candidates, offers, offer_text, page).select(
        F.col("page").alias("_page"), F.col("name").alias("_name"), F.lit(True).alias("_hit")
    )
    keyed = candidates.withColumn("_key", normalize_search("product"))
    joined = keyed.join(covered, (keyed[page] == F.col("_page")) & (F.col("_key") == F.col("_name")), "left")
    return joined.withColumn("existing", F.coalesce("_hit", F.lit(False))).drop("_page", "_name", "_hit", "_key")


def already_in(candidates: DataFrame, offers: DataFrame, offer_text: Column, fold, page: str = "pageNumber") -> DataFrame:
    """Distinct (page, name) of candidates already covered by an offer.

    Compared with the offers of the same page, or with all offers where the page
    has none.  Covered: text contains name, name contains text, or the first
    three long words (at least two) all occur in the text.
    """
    wanted = _named(candidates.filter(fold("product") != ""), page, name=fold("product"))
    known = _named(offers.filter(offer_text != ""), page, text=offer_text)
    busy = known.select("page").distinct()
    # Tables that grow with the pages are never broadcast: their estimates leave out what was derived.
    here = wanted.join(busy.hint("merge"), "page", "left_semi")
    elsewhere = wanted.join(busy.hint("merge"), "page", "left_anti")
    everything = known.groupBy("text").agg(F.min("key").alias("key"))

    def covered(names: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
        # A text with the name has its words, so these alone decide where there are two.
        long_words = F.slice(words_of(F.col("name"), 4), 1, 3)
        either = names.select(*on, F.col("key").alias("needle"), F.when(F.size(long_words) >= 2, long_words).otherwise(F.array("name")).alias("parts"))
        forward = substring_join(texts, either, text_id="key", text="text", needle_id="needle", parts="parts", on=on)
        inner = texts.select(*on, F.col("key").alias("needle"), F.array("text").alias("parts"))
        backward = substring_join(names, inner, text_id="key", text="name", needle_id="needle", parts="parts", on=on)
        found = forward.select(F.col("needle").alias("key"))
        return names.join(found.union(backward.select("key")).distinct().hint("merge"), "key", "left_semi").select("page", "name")

    return covered(here, known, ["page"]).union(covered(elsewhere, everything, []))


# --- pages -------------------------------------------------------------------
def pages_with_counts(pages: DataFrame, offers: DataFrame, page: str = "pageNumber") -> DataFrame:
    """Every page with its number of offers, zero included.

    The offers are counted before the join, so a crowded page is one row.
    """
    counts = offers.groupBy(page).agg(F.count(F.lit(1)).alias("offers"))
    return pages.join(counts.hint("merge"), page, "left").withColumn("offers", F.coalesce("offers", F.lit(0)))


def key_occurrences(texts: DataFrame, keys: DataFrame, *, text_id: str, text: str, key: str, before: int = 500,
                    after: int = 1000) -> DataFrame:
    """Where each key first occurs in each text, with its surroundings."""
    known = keys.select(F.col(key).alias("_key")).distinct()
    needles = known.select("_key", F.array("_key").alias("_parts"))

    def place(value: Column, parts: Column) -> list[Column]:
        pos = F.instr(value, parts[0]) - 1
        start = F.greatest(pos - before, F.lit(0))
        return [pos.alias("pos"), F.substring(value, start + 1, pos + after - start).alias("context")]

    pairs = substring_join(texts, needles, text_id=text_id, text=text, needle_id="_key", parts="_parts", derive=place)
    return pairs.select(text_id, F.col("_key").alias(key), "pos", "context")
