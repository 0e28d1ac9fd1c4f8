"""Near-duplicate groups by HyperMinHash sketches.

A document is the set of its word shingles, each a 64-bit hash. Its sketch has REGISTERS buckets; a bucket keeps, of its
least hash, the count of leading zeros and MANTISSA bits after them (16 bits in all). For banding, an empty bucket borrows from the
full bucket that comes first in a fixed random order of its own, so that short documents band as well as long ones; BANDS
bands of ROWS registers catch a pair of similarity 0.8 but for 3 in a million.

1. Documents of equal sets form classes; one row per class goes on, under its smallest id.
2. In every band bucket, all members pair with one pivot: the member whose buckets hold most members, which stands
   in the middle of its near copies. Pairs are estimated by their sketches, corrected for registers that agree by chance;
   those not clearly below 0.4 are verified on the full sets, which gives their similarity. At the threshold or above they link.
3. What is left are pairs of which neither is the pivot, and the pivot links one of them at most. By the triangle inequality
   of the Jaccard distance, the distances to the pivot of two members that link differ by 0.2 at most. So where one member
   has a similarity of 0.6 or more to the pivot, the other has 0.4 or more. All members of 0.4 or more are cut into
   blocks of BLOCK, those that the pivot doesn't link into blocks as well, and each of the latter is compared with all
   of the former on full sets, a pair of blocks in one row. Nothing leaves it but links between different components.
4. Members whose similarity to the bucket's pivot is below 0.6 pair among themselves, and are estimated and verified.
   (0.6 and 0.4 are for a threshold of 0.8; they follow from it.)

So every pair of a bucket is verified, connected or excluded by the inequality, no bucket emits its pairs, and groups of any size
are connected through pivots.

Ids, sketches and, for verification, the two texts of a pair travel; a third of all rows in one group is a key whose
join Spark splits at run time. Rounds are written to the shared folder. Nothing is collected but two numbers per round.

Null and empty texts, and texts without words, have no shingles and link with nothing. A text of fewer words than
a shingle is one shingle. Rows that share an id are one document: their links are one another's, and they stay or go together.
Rows without an id get no component and are kept. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import map_slices, staged

REGISTERS, BANDS, ROWS = 252, 42, 6
REST_BITS, MANTISSA = 40, 10
EMPTY = 0xFFFF
#: Estimates this many standard errors below a similarity are taken to be below it (3 in ten million are not).
MARGIN = 5.0
#: Members per block.
BLOCK = 128
#: Words whose hashes a task remembers; the table is emptied when full.
MAX_REMEMBERED = 400_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Chance that two unequal minima share a register: both must have the same leading zeros (1/3) and mantissa.
CHANCE = 1 / 3 / (1 << MANTISSA)
_ORDER = np.random.default_rng(20240501).permuted(np.tile(np.arange(REGISTERS, dtype=np.int32), (REGISTERS, 1)), axis=1)


class _Hashes(dict):
    """64-bit hashes by word (bytes), bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text. bytes.lower() and bytes.split() know ASCII letters and white space only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    span = min(size, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        out = _finish(out * _ODD[0] + h[k : len(words) - span + 1 + k])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of hashes; EMPTY where a bucket has none."""
    bucket = ((hashes >> np.uint64(REST_BITS)) * np.uint64(REGISTERS)) >> np.uint64(64 - REST_BITS)
    least = np.full(REGISTERS, 1 << REST_BITS, np.uint64)
    np.minimum.at(least, bucket.astype(np.intp), hashes & np.uint64((1 << REST_BITS) - 1))
    used = least < np.uint64(1 << REST_BITS)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint64)  # exact below 2**53
    zeros = np.uint64(REST_BITS) - np.minimum(bits, np.uint64(REST_BITS))
    mantissa = ((least << (zeros + np.uint64(1))) >> np.uint64(REST_BITS - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return np.where(used, (zeros << np.uint64(MANTISSA)) | mantissa, EMPTY).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Keys of the bands; empty registers borrow first."""
    full = registers != EMPTY
    if not full.any():
        return np.empty(0, np.int64)
    values = registers.astype(np.uint64)
    lack = np.flatnonzero(~full)
    if len(lack):
        have = np.flatnonzero(full)
        values[lack] = values[have[_ORDER[np.ix_(lack, have)].argmin(axis=1)]]
    rows = values.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = _finish(keys * _ODD[k] + rows[:, k])
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Similarity of two sketches, corrected for chance agreement, and the number of registers that it rests on."""
    told = (a != EMPTY) | (b != EMPTY)
    n = int(told.sum())
    agree = np.count_nonzero((a == b) & told) / max(1, n)
    return max(0.0, (agree - CHANCE) / (1 - CHANCE)), n


def sketches(docs: DataFrame, size: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, t_a (hash of the text), n (set size), sig_a and sig_b (hash of the set), registers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for value in batch.column("text").to_pylist():
            found = shingles(value, size)
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            signed = np.array([digest & (1 << 64) - 1, digest >> 64], np.uint64).view(np.int64)
            for column, x in zip(out, (len(found), signed[0], signed[1], sketch(found).tobytes() if len(found) else None), strict=True):
                column.append(x)
        arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["id", "t_a", "n", "sig_a", "sig_b", "registers"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t_a"), F.col(text).alias("text"))
    return map_slices(rows, run, "id long, t_a long, n long, sig_a long, sig_b long, registers binary")


def bucket_members(classes: DataFrame) -> DataFrame:
    """key, id: the band buckets that hold two ids at least."""

    def run(batches):
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column("registers").to_pylist()]
            ids = np.repeat(batch.column("id").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, np.int64)])), pa.array(ids, pa.int64())], names=["key", "id"])

    rows = staged(classes.select("id", "registers").mapInArrow(run, "key long, id long").distinct())
    shared = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("size")).where("a < b").select("key", "size")
    return rows.join(staged(shared), "key")


def _similarities(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """a, b, both (shared shingles) and all (shingles of either) of the pairs whose estimate isn't clearly below `least`."""

    def likely(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ra").to_pylist(), batch.column("rb").to_pylist(), strict=True):
                similarity, n = estimate(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16))
                keep.append(similarity >= least - MARGIN * (least * (1 - least) / max(1, n)) ** 0.5)
            yield batch.select(["a", "b", "ta", "tb"]).filter(pa.array(keep, pa.bool_()))

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared, either, memo = [], [], {}
        for b, x, y in zip(batch.column("b").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if b not in memo:
                memo = {b: shingles(y, size)}  # pivots stand together
            left, right = shingles(x, size), memo[b]
            shared.append(len(np.intersect1d(left, right, assume_unique=True)))
            either.append(len(left) + len(right) - shared[-1])
        columns = [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(either, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "both", "all"])

    side = lambda x: classes.select(F.col("id").alias(x), F.col("t_a").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb"))
    found = joined.select("a", "b", "ta", "tb", "ra", "rb").mapInArrow(likely, "a long, b long, ta long, tb long")
    text = lambda x: texts.select(F.col("id").alias(x), F.col("t_a").alias(f"t{x}"), F.col("text").alias(f"text_{x}"))
    both = found.join(text("a"), ["a", "ta"]).join(text("b"), ["b", "tb"]).select("a", "b", "text_a", "text_b")
    return map_slices(both, exact, "a long, b long, both long, all long", "text_a")


def _block_links(near: DataFrame, classes: DataFrame, texts: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between different components among the members (id, p, linked) of the same pivot p.

    A pair of members is compared if one of them is not linked with the pivot. Only pivots with such members take part.
    """
    open_pivots = near.where("not linked").groupBy("p").agg(F.count("*").alias("x")).select("p")
    number = near.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(open_pivots, "p")
    rows = near.join(staged(number), "p").join(labels, "id", "left").withColumn("c", F.coalesce("label", "id"))
    rows = rows.join(classes.select("id", "t_a"), "id").join(texts, ["id", "t_a"])
    cut = F.pmod(F.xxhash64(F.lit(11), "id"), F.col("blocks"))
    rows = rows.select("p", "id", "c", "linked", cut.alias("block"), "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(x, size).tobytes() for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], "set"])

    rows = staged(map_slices(rows, sets, "p long, id long, c long, linked boolean, block long, set binary"))
    member = F.collect_list(F.struct("id", "c", "set"))
    whole = rows.groupBy("p", "block").agg(member.alias("whole"))
    strays = rows.where("not linked").groupBy("p", "block").agg(member.alias("strays")).drop("block")

    def compare(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for left, right in zip(batch.column("strays").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                out += linked_pairs(left, right, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return strays.join(whole, "p").select("strays", "whole").mapInArrow(compare, "a long, b long")


def linked_pairs(left: list[dict], right: list[dict], percent: int) -> list[tuple[int, int]]:
    """(id, id) of members of two blocks that link and are of different components."""
    sets = [np.frombuffer(x["set"], np.uint64) for x in right]
    sizes = np.array([len(x) for x in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(values, kind="stable")
    values, owner = values[by], owner[by]
    components, out = np.array([x["c"] for x in right]), []
    for x in left:
        own = np.frombuffer(x["set"], np.uint64)
        begin, end = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        counts = end - begin
        at = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        good = (100 * both >= percent * (len(own) + sizes - both)) & (components != x["c"])
        out += [(x["id"], right[k]["id"]) for k in np.flatnonzero(good)]
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and label (the smallest id of its component) of every id in links but those that are their own label."""
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
        mark = now
        # Large star: every larger neighbour of u points at the least of u and its neighbours.
        both = edges.union(edges.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point at the least of them.
        large = staged(large)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct())


def group(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of docs: id, t_a, n_shingles, component_id, kept."""
    all_rows = staged(sketches(docs, size, id_col, text))
    named = all_rows.where("id is not null and n > 0")
    classes = named.groupBy("sig_a", "sig_b").agg(F.min(F.struct("id", "t_a")).alias("of"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = staged(classes.select("sig_a", "sig_b", "of.*", "n", "registers"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t_a"), F.col(text).alias("text"))
    members = staged(bucket_members(classes))
    share = percent / 100
    # The least similarity to a pivot of what can link with a member that the pivot links, and with one of these.
    loose, wide = max(0.0, 2 * share - 1), max(0.0, 3 * share - 2)

    # The pivot of a bucket: the member that shares buckets with most others.
    weight = members.groupBy("id").agg(F.sum("size").alias("w"))
    placed = members.join(weight, "id")
    pivots = placed.groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("p"))
    stars = staged(members.join(staged(pivots), "key").where("id <> p").select("key", "id", "p"))
    tested = stars.select(F.col("id").alias("a"), F.col("p").alias("b")).distinct()
    known = staged(_similarities(tested, classes, texts, size, wide))
    enough = 100 * F.col("both") >= percent * F.col("all")
    links = known.where(enough)
    # An id with several texts ties their classes together; such ids are few, so the joins that follow are small.
    by_set = F.struct("sig_a", "sig_b")
    several = named.groupBy("id").agg(F.min(by_set).alias("x"), F.max(by_set).alias("y")).where("x <> y").select("id")
    of = named.join(staged(several), "id").select("id", "sig_a", "sig_b").distinct()
    of = staged(of.join(classes.select("sig_a", "sig_b", F.col("id").alias("c")), ["sig_a", "sig_b"]).select("id", "c"))
    ties = of.join(of.groupBy("id").agg(F.min("c").alias("m")), "id").where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b"))
    links = links.select("a", "b").union(ties)
    first = staged(components(links))

    near = known.where(F.col("both") >= wide * F.col("all")).select(F.col("a").alias("id"), F.col("b").alias("p"), enough.alias("linked"))
    blocks = _block_links(near, classes, texts, first, size, percent)
    # Members that the bucket's pivot is far from pair among themselves.
    close = known.where(F.col("both") >= loose * F.col("all")).select(F.col("a").alias("id"), F.col("b").alias("p"))
    far = stars.join(close, ["id", "p"], "left_anti").select("key", "id")
    pairs = far.join(far.select("key", F.col("id").alias("other")), "key").where("id < other")
    pairs = pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    rest = _similarities(staged(pairs), classes, texts, size, share).where(enough)
    more = blocks.union(rest.select("a", "b"))
    label = F.coalesce("label", "id")
    merged = more.join(_named(first, "a", "ca"), "a", "left").join(_named(first, "b", "cb"), "b", "left")
    merged = merged.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = staged(components(merged))

    labels = classes.select("sig_a", "sig_b", "id").join(first, "id", "left").select("sig_a", "sig_b", label.alias("c"))
    labels = labels.join(_named(second, "c", "d"), "c", "left").select("sig_a", "sig_b", F.coalesce("d", "c").alias("component"))
    out = all_rows.select("id", "t_a", "n", "sig_a", "sig_b").join(staged(labels), ["sig_a", "sig_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    out = out.select("id", "t_a", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _named(labels: DataFrame, key: str, label: str) -> DataFrame:
    return labels.select(F.col("id").alias(key), F.col("label").alias(label))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept: the smallest id of each group, with all columns."""
    gone = group(docs, size, percent, id_col, text).where(~F.col("kept")).select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
