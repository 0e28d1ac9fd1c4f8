"""Removal of long word passages that an earlier document has: a compacted de Bruijn graph of word windows.

A window is `window` consecutive words of one document. Windows are the edges of a de Bruijn graph: one edge leads from its
first window - 1 words to its last window - 1. A word goes if a window covers it whose word sequence also starts in a document of a
smaller id.

1. Every window has one minimizer: the leftmost of its ANCHOR-word sequences of least hash. Successive windows with the same
   minimizer are one path (about one row per 18 words). The minimizer depends on the window's words only, so equal windows lie in paths with
   equal minimizers, wherever they occur.
2. Minimizers are counted: smallest and largest id, smallest and largest path hash. One id alone: nothing repeats, the path leaves.
   All its paths equal: a nonbranching stretch, compacted to one class; all its windows start in the smallest id. Else it branches.
3. At branching minimizers, equal paths are compacted to classes by a join, so that copies aren't expanded; only the first document of a class
   unpacks it into its windows, found by its source coordinates (row, first window, number of windows). The smallest id of each
   window says which windows of that first document go; in all later documents of the class all of them go.
4. The windows to go travel as coordinates with a bit mask, are gathered per document and join its text, where they are verified:
   a span must lie within the text and hold a whole window. Words outside all spans are joined by one space.

A class or window is identified by 128 bits from two independent hash functions of words. Hot minimizers (a passage that a third of the rows
share) are combined before the shuffle, and in joins Spark splits them at run time. A document gathers at most its own paths.
A task holds a slice of two megabytes or one text; a text needs some twenty times its size for a while.

Null and empty texts have no words and give an empty text. Fewer words than a window: nothing goes. Repeats within one document stay,
also across rows that share an id. Rows without an id keep all words and count for no other row. Repeated rows have equal results.
Empty tables give empty results. Other columns stay; n_words and n_removed replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import map_slices, slices, staged

#: Words of a minimizer.
ANCHOR = 16
#: Words that a worker remembers before it begins anew.
MAX_REMEMBERED = 250_000
#: Bytes of text that a task works on at a time.
SLICE = 2_000_000
#: Windows of a path at most, as they are bits of a long.
MAX_PATH = 62

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers of words (bytes), and by number two independent 64-bit hashes; emptied between slices when full."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []
        self.first = self.second = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number

    def hashes(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > MAX_REMEMBERED:
            self.clear()
            self.__init__()
        numbers = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.fresh:
            digests = b"".join(map(xxhash.xxh3_128_digest, self.fresh))
            pairs = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
            self.first, self.second = np.concatenate([self.first, pairs[:, 1]]), np.concatenate([self.second, pairs[:, 0]])
            self.fresh = []
        return self.first[numbers], self.second[numbers]


_words = _Words()


def words(text: str | None) -> list[bytes]:
    """bytes.split() knows ASCII white space only."""
    return (text or "").encode().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size tokens, from runs of powers of two."""
    n, power, span = len(tokens), tokens, 1
    out, taken = None, 0
    while True:
        if size & span:
            count = n - taken - span + 1
            out = power[:count].copy() if out is None else _mixed(out[:count] * _ODD + power[taken : taken + count])
            taken += span
        if 2 * span > size:
            return out
        power = _mixed(power[: n - 2 * span + 1] * _ODD + power[span : n - span + 1])
        span *= 2


def least(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the leftmost least value in each run of size values."""
    at, span, n = np.arange(len(values), dtype=np.int32), 1, len(values)
    while 2 * span <= size:
        left, right = at[: n - 2 * span + 1], at[span : n - span + 1]
        at = np.where(values[left] <= values[right], left, right)
        span *= 2
    left, right = at[: n - size + 1], at[size - span : n - span + 1]
    return np.where(values[left] <= values[right], left, right)


def window_paths(first: np.ndarray, second: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Paths of texts that lie one behind the other: start, number of windows, minimizer, path hash.

    first and second are the word hashes, ends[i] the end of the text that token i belongs to.
    """
    if len(first) < window:
        return (np.empty(0, np.int64),) * 4
    anchor = min(ANCHOR, window)
    grams = runs(first, anchor)
    at = least(grams, window - anchor + 1)
    whole = np.arange(len(at)) + window <= ends[: len(at)]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    place = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (ends[starts[1:]] != ends[starts[:-1]])
    head = np.flatnonzero(new)
    within = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
    if within.max() >= MAX_PATH:  # only where window is far longer than the minimizer
        new |= within % MAX_PATH == 0
        head = np.flatnonzero(new)
        within = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
    hashes = runs(second, window)[starts]
    path = np.add.reduceat(_mixed(hashes + (within.astype(np.uint64) + np.uint64(1)) * _ODD), head)
    return starts[head], np.diff(np.append(head, len(starts))), grams[place[head]].view(np.int64), path.view(np.int64)


def window_hashes(second: np.ndarray, start: int, n: int, window: int) -> np.ndarray:
    """Hashes of n windows from start on."""
    return runs(second[start : start + n + window - 1], window).view(np.int64)


def paths(docs: DataFrame, window: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per path: id, t_a (hash of the text), at (first window), n (windows), a (minimizer), p (path hash)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [words(x) for x in batch.column("text").to_pylist()]
        sizes = np.array([len(x) for x in tokens])
        ends = np.cumsum(sizes)
        start, n, a, p = window_paths(*_words.hashes([w for x in tokens for w in x]), np.repeat(ends, sizes), window)
        row = np.searchsorted(ends, start, side="right")
        rows = pa.array(row)
        columns = [
            batch.column("id").take(rows), batch.column("t_a").take(rows),
            *[pa.array(x, t) for x, t in ((start - (ends - sizes)[row], pa.int32()), (n.astype(np.int32), pa.int32()), (a, pa.int64()), (p, pa.int64()))],
        ]
        return pa.RecordBatch.from_arrays(columns, names=["id", "t_a", "at", "n", "a", "p"])

    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t_a"), F.col(text).alias("text")
    )
    return map_slices(rows, run, "id long, t_a long, at int, n int, a long, p long", slice_bytes=SLICE)


def _unpacked(heads: DataFrame, docs: DataFrame, window: int, id_col: str, text: str) -> DataFrame:
    """Windows of the heads of classes (a, p, id, t_a, at, n), from their texts: a, p, first (the id), j, w (hash)."""
    gathered = heads.groupBy("id", "t_a").agg(F.collect_list(F.struct("at", "n", "a", "p")).alias("heads"))
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t_a"), F.col(text).alias("text")
    )
    rows = texts.join(gathered, ["id", "t_a"]).select("id", "text", "heads")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for i, value, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            second = _words.hashes(words(value))[1]
            for head in found:
                n = head["n"]
                w = window_hashes(second, head["at"], n, window)
                for column, x in zip(out, (np.full(n, head["a"]), np.full(n, head["p"]), np.full(n, i), np.arange(n), w), strict=True):
                    column.append(x)
        arrays = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in out]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "p", "first", "j", "w"])

    return map_slices(rows, run, "a long, p long, first long, j long, w long", slice_bytes=SLICE)


def repeated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows that start in a smaller id too: id, t_a, at (first window of a path), mask (bit j: window at + j goes)."""
    found = staged(paths(docs, window, id_col, text))
    shared = found.groupBy("a").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), (F.min("p") != F.max("p")).alias("branches")
    ).where("first < last").select("a", "first", "branches")
    # Joins with written tables, so that Spark can split their hot keys.
    rows = staged(found.join(staged(shared), "a"))

    classes = rows.where("branches").groupBy("a", "p").agg(
        F.min(F.struct("id", "t_a", "at", "n")).alias("head")
    ).select("a", "p", "head.*")
    heads = staged(classes)
    unpacked = staged(_unpacked(heads, docs, window, id_col, text))
    earliest = unpacked.groupBy("a", "w").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
    gone = unpacked.join(staged(earliest.drop("most")), ["a", "w"]).where("least < first")
    masks = gone.groupBy("a", "p").agg(F.bit_or(F.expr("shiftleft(1L, cast(j AS INT))")).alias("part"))
    resolved = staged(heads.select("a", "p", F.col("id").alias("head")).join(masks, ["a", "p"], "left"))

    every = F.expr("shiftleft(1L, n) - 1")
    plain = rows.where("NOT branches AND id > first").select("id", "t_a", "at", every.alias("mask"))
    branching = rows.where("branches").join(resolved, ["a", "p"]).select(
        "id", "t_a", "at", F.when(F.col("id") > F.col("head"), every).otherwise(F.coalesce("part", F.lit(0))).alias("mask")
    ).where("mask <> 0")
    return plain.unionByName(branching)


def _covered(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Words that the spans' windows cover. Raises if a span leaves the text."""
    edge = np.zeros(n_words + 1, np.int64)
    for span in spans:
        mask, start = span["mask"], span["at"]
        while mask:  # runs of set bits
            low = (mask & -mask).bit_length() - 1
            run = ((mask >> low) ^ ((mask >> low) + 1)).bit_length() - 1
            if start + low < 0 or start + low + run + window - 1 > n_words:
                raise ValueError("a repeated span lies outside its text")
            edge[start + low] += 1
            edge[start + low + run + window - 1] -= 1
            mask &= ~(((1 << run) - 1) << low)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text replaced by its kept words joined by one space, and n_words and n_removed."""
    spans = repeated(docs, window, id_col, text).groupBy("id", "t_a").agg(F.collect_set(F.struct("at", "mask")).alias("__spans"))
    spans = spans.withColumnsRenamed({"id": "__id", "t_a": "__t_a"})
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rows = docs.select(*names, F.xxhash64(F.col(text)).alias("__hash"))
    rows = rows.join(spans, (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__hash") == F.col("__t_a")), "left")
    rows = rows.select(*names, "__spans")
    schema = docs.select(*names).schema.add("n_words", "long").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                kept, n, removed = [], [], []
                for value, found in zip(part.column(text).to_pylist(), part.column("__spans").to_pylist(), strict=True):
                    tokens = words(value)
                    n.append(len(tokens))
                    if found:
                        tokens = [tokens[i] for i in np.flatnonzero(~_covered(len(tokens), found, window))]
                    removed.append(n[-1] - len(tokens))
                    kept.append(b" ".join(tokens))
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    return rows.mapInArrow(run, schema)
