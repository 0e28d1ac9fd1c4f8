"""Benchmark decontamination by spaced seeds (built-in functions only).

Texts are words in lower case (runs of letters and digits). A seed is a fixed mask over SPAN consecutive words that
ignores some of them, so a window still hashes alike if an ignored word was replaced. Every window of every document is hashed
under every mask and joined with the hashes of the benchmark's windows. A hit aligns document and item; the words around it
are compared, and a stretch of MIN_WORDS words (the whole of a shorter item) that holds the hit must agree in
MIN_SHARE of its words. The masks miss nothing that agrees so: wherever the unequal words of a stretch stand, some mask lies inside it
and uses equal words only (tests enumerate them all). Items shorter than SPAN words have masks of their own length.

No text is shuffled. Words become 64-bit hashes in place, and array operations combine them to seeds; generating and probing
seeds, comparing the words around a hit and combining hits by (document, item) is one compiled loop, so that a document's hits are
never held together. A window of the benchmark is a seed, its item's number and a place; the items' words are broadcast beside the
windows. At most max_broadcast windows (counted first) are broadcast at once: a larger benchmark is dealt by item over several
passes over the documents, so that memory stays the same and time grows with the benchmark. With max_broadcast=0 nothing is
broadcast: the join is left to Spark, which shuffles the documents' windows with the words around them.

Null or empty texts have no words and no hits. Repeated rows are one document by their id; rows with a null id are reported
under a null id, each text by itself. An item whose text is null or empty is never found. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import bound, staged

#: Masks over SPAN words at most, as the places they use: 11101100, 11010011 and 11111000.
SPAN = 8
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4))
#: An overlap counts at this many words (or the whole of a shorter item) and this share of equal words.
MIN_WORDS, MIN_SHARE = 13, 0.8
#: Words before and after a mask's first word that a stretch around the mask can reach.
BEFORE, AFTER = MIN_WORDS - 1 - min(m[-1] for m in MASKS), MIN_WORDS - 1
#: Benchmark windows that are broadcast at once at most (about 90 bytes each; 500,000 while they carried their words, of 400 bytes).
MAX_BROADCAST = 2_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Masks of an item shorter than SPAN: all its words, or where one may differ, all but two neighbours in turn."""
    if length - 1 < MIN_SHARE * length:
        return [tuple(range(length))]
    return [tuple(k for k in range(length) if k not in (skip, skip + 1)) for skip in range(0, length, 2)]


def _seeds(words: Column, short: list[tuple[int, tuple[int, ...]]]) -> Column:
    """Array of seeds: for each mask, then each one of short, the hash at every position (number of mask * size + position).

    Where words lack at the end, the hash is of those that are there.
    """
    later = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0))) if k else x

    def masked(pairs: Column, number: int, mask: tuple[int, ...]) -> Column:
        parts, at = [], 0
        while at < len(mask):
            paired = mask[at + 1 : at + 2] == (mask[at] + 1,)
            parts.append(later(pairs if paired else words, mask[at]))
            at += 2 if paired else 1
        out = F.zip_with(parts[0], parts[1], lambda x, y: F.xxhash64(F.lit(number), x, y))
        for part in parts[2:]:
            out = F.zip_with(out, part, lambda x, y: F.xxhash64(x, y))
        return out

    def run(number: int, mask: tuple[int, ...]) -> Column:
        return F.transform(words, lambda w, i: F.xxhash64(F.lit(number), *[F.get(words, i + k) for k in mask]))

    pairs = F.zip_with(words, later(words, 1), lambda x, y: F.xxhash64(x, y))
    shorter = [run(len(MASKS) + i, mask) for i, (_, mask) in enumerate(short)]
    return bound(pairs, lambda p: F.concat(*[masked(p, i, mask) for i, mask in enumerate(MASKS)], *shorter))


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """number, item_id, b_words, b_size of the items with words; items of equal words are one, under the smallest id."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("b_words"))
    rows = rows.groupBy("b_words").agg(F.min("item_id").alias("item_id"))
    # Written, so that every reader finds the same numbers.
    return staged(rows.withColumn("b_size", F.size("b_words")).where("b_size > 0").withColumn("number", F.monotonically_increasing_id()))


def benchmark_windows(items: DataFrame, short: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """seed, number (of the item), place (of the window's first word): the hashes of all windows of all items."""
    rows = items.withColumn("b_seeds", _seeds(F.col("b_words"), short))
    rows = rows.select("number", "b_size", F.posexplode("b_seeds").alias("b_at", "seed"))
    # A short mask serves only the items of its own length, from their first word.
    mask, place = F.floor(F.col("b_at") / F.col("b_size")), F.col("b_at") % F.col("b_size")
    whole = F.element_at(F.lit([0] * len(MASKS) + [length for length, _ in short]), (mask + 1).cast("int"))
    rows = rows.where((mask < len(MASKS)) | ((whole == F.col("b_size")) & (place == 0)))
    return rows.select("seed", "number", place.alias("place"))


def _matched(near: Column, b_near: Column, left: Column, place: Column, b_size: Column) -> Column:
    """Equal words of the best stretch that holds the hit, or null if it falls short; left: words that near and b_near have before the hit."""
    paired = F.zip_with(near, b_near, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    equal = F.concat(F.array_repeat(F.lit(0), BEFORE - left), paired)
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    inside = lambda i: (place + i >= BEFORE) & (place + i + (MIN_WORDS - BEFORE) <= b_size)

    def best(flags: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.lit(BEFORE)), lambda i: F.when(inside(i), total(F.slice(flags, i + 1, MIN_WORDS))))
        return F.when(b_size < MIN_WORDS, total(flags)).otherwise(F.array_max(stretches))

    enough = lambda n: F.when(n >= MIN_SHARE * F.least(b_size, F.lit(MIN_WORDS)), n)
    return bound(bound(equal, best), enough)


def _around(hits: DataFrame, words: Column, at: Column) -> DataFrame:
    """hits with left, near and b_near: the words of document and item around the hit, from left before it on.

    They leave a generator of one row, since a projection would be merged with the comparison, which isn't compiled: each hit
    of a document would then be held with all its words until the document is done.
    """
    left = F.least(at, F.col("place"), F.lit(BEFORE))
    cut = lambda of, first: F.slice(of, first - left + 1, left + (AFTER + 1))
    few = F.struct(left.alias("left"), cut(words, at).alias("near"), cut(F.col("b_words"), F.col("place")).alias("b_near"))
    return hits.select("doc_id", "apart", "item_id", "b_size", "place", F.explode_outer(F.array(few)).alias("few")).select("*", "few.*")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Verified overlaps by document and item: doc_id, apart (which tells texts without an id apart), item_id, n_item_words, n_matched."""
    items = benchmark_items(benchmark)
    lengths = sorted(r["b_size"] for r in items.where(F.col("b_size") < SPAN).select("b_size").distinct().collect())  # at most SPAN - 1
    short = [(length, mask) for length in lengths for mask in short_masks(length)]
    rows = docs.select(F.col(id_col).alias("doc_id"), _apart(docs, id_col, text).alias("apart"), word_hashes(F.col(text)).alias("words"))
    probes = rows.withColumn("seeds", _seeds(F.col("words"), short))
    # The outer form keeps Spark from adding a filter on the seeds' number, which would compute them twice.
    probes = probes.select("doc_id", "apart", "words", F.posexplode_outer("seeds").alias("at", "seed")).where("seed is not null")
    at = F.col("at") % F.size("words")
    if max_broadcast > 0:
        passes = max(1, -(-benchmark_windows(items, short).count() // max_broadcast))
        parts = [items.where(F.pmod("number", F.lit(passes)) == k) for k in range(passes)] if passes > 1 else [items]
        joined = [probes.join(F.broadcast(benchmark_windows(part, short)), "seed").join(F.broadcast(part), "number") for part in parts]
        hits = reduce(DataFrame.unionByName, [_around(rows, F.col("words"), at) for rows in joined])
    else:
        before = F.least(at, F.lit(BEFORE))
        cut = F.slice("words", at - before + 1, before + (AFTER + 1)).alias("words")
        rows = probes.select("doc_id", "apart", "seed", before.alias("at"), cut).join(benchmark_windows(items, short), "seed").join(items, "number")
        hits = _around(rows, F.col("words"), F.col("at"))
    matched = _matched(F.col("near"), F.col("b_near"), F.col("left"), F.col("place"), F.col("b_size")).alias("n")
    hits = hits.select("doc_id", "apart", "item_id", "b_size", matched)
    # The test comes after the grouping; before it, Spark would make it a condition of the join, which then isn't compiled.
    found = hits.groupBy("doc_id", "apart", "item_id").agg(F.max("b_size").alias("n_item_words"), F.max("n").alias("n_matched"))
    return found.where("n_matched is not null")


def _apart(docs: DataFrame, id_col: str, text: str) -> Column:
    return F.when(docs[id_col].isNull(), F.md5(docs[text].cast("binary")))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """Verified overlaps, one row per document and item: doc_id, item_id, n_item_words, n_matched (of the best stretch)."""
    return _found(docs, benchmark, id_col, text, max_broadcast).drop("apart")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all their columns."""
    found = _found(docs, benchmark, id_col, text).select(F.col("doc_id").alias("__found"), F.col("apart").alias("__apart")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__found")) & _apart(docs, id_col, text).eqNullSafe(F.col("__apart"))
    return docs.join(found, same, "left_anti")
