"""Phrase collocations by Toivonen's sampling method.

Texts (A-Z in lower case) are cut into pieces at punctuation and line ends, pieces into words. Per language, phrases of 2 to max_words
words that occur at least min_count times within pieces are candidates, scored by how much more often they occur than their parts.

1. A sample (a share of the rows, by a hash of the text) proposes phrases: those with sample_count occurrences in it. All words are
   proposed, as a small sample can rule out none. The proposals (but for the longest phrases) go into a bit table of at most
   FILTER_BITS bits, which is broadcast; what it holds too much is only counted too much.
2. One pass over all rows counts, exactly, the proposed phrases and the negative border: the phrases that weren't proposed but whose parts
   (one word less at either end) were.
3. A border phrase that reaches min_count in the full count is a failure: longer phrases that hold it may have been left out.
   The failures join the bit table and another full pass counts the phrases that the new table admits and the old ones didn't.
   This repeats until no pass has a failure; as phrases grow by a word each time, max_words - 1 passes always suffice.

Tasks count in chunks of CHUNK words. A phrase is known by the 64-bit hashes of its words, seeded by the language. A chunk's counts are dealt by a
hash of the phrase into blocks of packed numbers, one per partition; Spark shuffles the blocks, and each partition adds up its phrases.
So a frequent word, phrase or language is one entry per chunk, and partitions are even. The least score of a phrase's cuts is computed in decimals of 38 digits. Phrases inside longer candidates that have
percent % of their occurrences are dropped. Ranking keeps top_k rows of each task and language before the shuffle.

A null text is empty, a null language `und`. Languages without candidates have no rows. Repeated rows count each. Ties go to the more frequent,
then to the smaller phrase in byte order. Empty tables give empty results. Other columns are not read. A task holds a slice of
some megabytes or one text, and its counts of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewren.llm.common import LOWER, UPPER, slices, staged

#: Words that a task counts before it hands on its counts.
CHUNK = 800_000
#: Words that a task numbers at a time; after more, the counts are handed on and numbering begins anew.
MAX_NUMBERED = 250_000
#: Bits of the table of admitted phrases at most (16 MB).
FILTER_BITS = 27
_ENDS = ".,;:!?\n\x0b\x0c\r"
#: A byte that UTF-8 never holds stands for the end of a piece.
_TABLE = bytes.maketrans((UPPER + _ENDS + "\t").encode(), LOWER.encode() + b"\xff" * len(_ENDS) + b" ")


def pieces_as_words(text: str | None) -> list[bytes]:
    """Words of a text in lower case, with the byte FF between pieces. Only blanks are left for bytes.split() to cut at."""
    return (text or "").encode().translate(_TABLE).replace(b"\xff", b" \xff ").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return _mixed(phrase * np.uint64(0x9E3779B97F4A7C15) + word)


class Admitted:
    """A set of phrase hashes as a table of 2**bits bits, two for each hash: it may hold too much, never too little."""

    def __init__(self, bits: int, table: np.ndarray) -> None:
        self.bits, self.table = bits, table

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = hashes.view(np.uint64)
        mask = np.uint64((1 << bits) - 1)
        return hashes & mask, (hashes >> np.uint64(33)) & mask

    @classmethod
    def of(cls, hashes: DataFrame, bits: int) -> Admitted:
        """From a column h. Words of the table are put together in Spark; no more than its size comes to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(cls.places(batch.column(0).to_numpy(), bits))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], names=["w", "b"])

        words = hashes.mapInArrow(run, "w long, b int").groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()
        table = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
        table[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
        return cls(bits, table)

    def __or__(self, other: Admitted) -> Admitted:
        return Admitted(self.bits, self.table | other.table)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.bits):
            out &= (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


class _Counter:
    """Counts of the phrases of one language in a chunk."""

    def __init__(self, lang: str, max_words: int, admitted: Admitted | None, before: Admitted | None, first: bool) -> None:
        self.lang, self.max_words, self.admitted, self.before, self.first = lang, max_words, admitted, before, first
        self.seed = np.array([xxhash.xxh3_64_intdigest(lang.encode())], np.uint64)
        self.numbers: dict[bytes, int] = {b"\xff": 0}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        numbers = self.numbers
        for word in set(words).difference(numbers):
            numbers[word] = len(numbers)
        self.held += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        self.size += len(words) + 1

    def counts(self) -> Iterator[tuple[list[np.ndarray], np.ndarray, list[bytes] | None]]:
        """Phrases as columns of word hashes, and their numbers of occurrences, by length: words and pairs on the first pass, longer ones as admitted.

        Words come with their texts; before them, without columns, the number of all words.
        """
        words, line = list(self.numbers), np.concatenate(self.held)
        self.held = []
        hashes = _longer(self.seed, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        there = line != 0
        found = np.bincount(line, minlength=len(words))
        found[0] = 0
        if self.first:
            yield [], np.array([found.sum()]), None
            used = np.flatnonzero(found)
            if len(used):
                yield [hashes[used]], found[used], [words[k] for k in used]
        # Phrases of m words that start at `at`: `kind` is their number among the distinct ones, whose words are in columns and whose hashes in keys.
        at = np.flatnonzero(there)
        kind, columns, keys = line[at], [np.arange(len(words))], hashes
        for m in range(2, self.max_words + 1):
            if m == 2:
                keep = np.append(there, False)[at + 1]
                at, kind = at[keep], kind[keep]
                new = np.full(len(at), self.first)
            else:  # both phrases of a word less must be admitted; by the tables of earlier passes, they were counted then
                kinds = np.full(len(line) + 1, -1, np.int64)
                kinds[at] = kind
                keep = kinds[at + 1] >= 0
                at, kind = at[keep], kind[keep]
                after = kinds[at + 1]
                now = self.admitted.has(keys) if self.admitted is not None else np.ones(len(keys), bool)
                old = self.before.has(keys) if self.before is not None else np.zeros(len(keys), bool)
                keep = now[kind] & now[after]
                new = ~(old[kind] & old[after])[keep]
                at, kind = at[keep], kind[keep]
            if not len(at):
                return
            distinct, kind, n = np.unique(kind * len(words) + line[at + m - 1], return_inverse=True, return_counts=True)
            start, end = np.divmod(distinct, len(words))
            keys = _longer(keys[start], hashes[end])
            columns = [*[c[start] for c in columns], end]
            counted = np.zeros(len(distinct), bool)
            counted[kind[new]] = True
            if counted.any():
                yield [hashes[c[counted]] for c in columns], n[counted], None


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """The hashes by which bit tables know phrases, from the hashes of their words."""
    found = columns[0]
    for column in columns[1:]:
        found = _longer(found, column)
    return found


_BLOCKS = pa.schema([("m", pa.int32()), ("r", pa.int32()), ("lang", pa.string()), ("keys", pa.binary()), ("n", pa.binary()), ("words", pa.list_(pa.binary()))])


def _blocks(lang: str, columns: list[np.ndarray], n: np.ndarray, words: list[bytes] | None, parts: int) -> pa.RecordBatch:
    """The counts of one length, dealt by phrase."""
    m = len(columns)
    dealt = (_mixed(phrase_hashes(columns)) % np.uint64(parts)).astype(np.int64) if m else np.array([xxhash.xxh3_64_intdigest(lang.encode()) % parts])
    order = np.argsort(dealt, kind="stable")
    edges = np.flatnonzero(np.diff(dealt[order])) + 1
    rows = []
    for part in np.split(order, edges):
        keys = np.stack([c[part] for c in columns]).tobytes() if m else b""
        rows.append((m, dealt[part[0]], lang if words is not None or not m else None, keys, n[part].astype(np.uint32).tobytes(), [words[k] for k in part] if words is not None else None))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct phrases, and their sums."""
    hashes = phrase_hashes(columns)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    equal = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    if (same & ~equal).any():  # two phrases of one hash
        order = np.lexsort(columns)
        equal = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    heads = np.flatnonzero(np.append(True, ~equal))
    return order[heads], np.add.reduceat(n[order], heads)


class _Sums:
    """Counts of the phrases of one length in one partition."""

    def __init__(self, m: int) -> None:
        self.m, self.held, self.size, self.known = m, [], 0, 0

    def add(self, row: dict) -> None:
        n = np.frombuffer(row["n"], np.uint32).astype(np.int64)
        columns = list(np.frombuffer(row["keys"], np.uint64).reshape(self.m, len(n)))
        texts = np.array([(row["lang"], w) for w in row["words"]], dtype="O,O") if self.m == 1 else None
        self.held.append((columns, n, texts))
        self.size += len(n)
        if self.size > 2 * self.known + CHUNK:
            self.close()

    def close(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray | None]:
        columns = [np.concatenate(x) for x in zip(*(h[0] for h in self.held), strict=True)]
        first, sums = _summed(columns, np.concatenate([h[1] for h in self.held]))
        texts = np.concatenate([h[2] for h in self.held])[first] if self.m == 1 else None
        self.held = [([c[first] for c in columns], sums, texts)]
        self.size = self.known = len(sums)
        return self.held[0]


def _counted(docs: DataFrame, max_words: int, least: int, admitted=None, before=None, first: bool = True) -> DataFrame:
    """keys (word hashes), n, and for words lang and word: what occurs at least `least` times. Without keys: lang and the number of its words."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [x.value if x is not None else None for x in (admitted, before)]
        held: dict[str, _Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            while held:
                lang, counter = held.popitem()
                for columns, n, words in counter.counts():
                    yield _blocks(lang, columns, n, words, parts)

        for batch in batches:
            for piece in slices(batch, "text", 2_000_000):
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    if lang not in held:
                        held[lang] = _Counter(lang, max_words, *tables, first)
                    held[lang].add(pieces_as_words(text))
                if sum(c.size for c in held.values()) >= CHUNK or sum(len(c.numbers) for c in held.values()) > MAX_NUMBERED:
                    yield from flush()
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, _Sums] = {}
        totals: dict[str, int] = {}
        for row in (row for batch in batches for start in range(0, batch.num_rows, 64) for row in batch.slice(start, 64).to_pylist()):
            if not row["m"]:
                totals[row["lang"]] = totals.get(row["lang"], 0) + int(np.frombuffer(row["n"], np.uint32)[0])
            else:
                sums.setdefault(row["m"], _Sums(row["m"])).add(row)
        if totals:
            yield pa.RecordBatch.from_pylist([{"keys": [], "n": n, "lang": lang} for lang, n in totals.items()], schema=_SUMS)
        for m, found in sums.items():
            columns, n, texts = found.close()
            keep = np.flatnonzero(n >= least)
            keys = np.stack([c[keep] for c in columns], axis=1).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(keep) + 1, m, dtype=np.int32)), pa.array(keys))
            lang, word = [pa.nulls(len(keep), pa.string())] * 2
            if m == 1:
                lang = pa.array([x[0] for x in texts[keep]], pa.string())
                word = pa.array([x[1] for x in texts[keep]], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lists, pa.array(n[keep]), lang, word], schema=_SUMS)

    blocks = docs.mapInArrow(count, "m int, r int, lang string, keys binary, n binary, words array<binary>")
    return staged(blocks.repartitionById(parts, F.col("r")).mapInArrow(add, "keys array<long>, n long, lang string, word string"))


_SUMS = pa.schema([("keys", pa.list_(pa.int64())), ("n", pa.int64()), ("lang", pa.string()), ("word", pa.string())])


def _hashed(counts: DataFrame) -> DataFrame:
    """h, the hashes of phrases of equal or different lengths, from their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            sizes, flat = np.asarray(keys.value_lengths()), np.asarray(keys.flatten()).view(np.uint64)
            starts = np.cumsum(sizes) - sizes
            found = np.zeros(len(sizes), np.uint64)
            for m in np.unique(sizes):
                rows = np.flatnonzero(sizes == m)
                found[rows] = phrase_hashes([flat[starts[rows] + k] for k in range(m)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    return counts.select("keys").mapInArrow(run, "h long")


def count_phrases(docs: DataFrame, max_words: int, min_count: int, share: int, sample_count: int, lang: str, text: str) -> DataFrame:
    """Every word and phrase that occurs min_count times at least, as keys, n and for words lang and word; without keys, lang and its number of words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sent = before = None
    if max_words > 2:
        sample = rows.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(share)) == 0)
        proposed = _counted(sample, max_words - 1, sample_count).where(F.size("keys") > 1)
        admitted = Admitted.of(_hashed(proposed), FILTER_BITS)
        sent = spark.sparkContext.broadcast(admitted)

    out = found = _counted(rows, max_words, min_count, sent)
    for _ in range(2, max_words):
        failures = staged(_rejected(_hashed(found.where(F.size("keys").between(2, max_words - 1))), sent))
        if failures.isEmpty():
            break
        before, admitted = sent, admitted | Admitted.of(failures, FILTER_BITS)
        sent = spark.sparkContext.broadcast(admitted)
        found = _counted(rows, max_words, min_count, sent, before, first=False)
        out = out.unionByName(found)
    return out


def _rejected(hashes: DataFrame, sent) -> DataFrame:
    """The hashes h that the table doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~sent.value.has(batch.column(0).to_numpy())))

    return hashes.mapInArrow(run, "h long")


def mine(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, percent: int = 50, top_k: int = 2000,
    share: int = 16, sample_count: int = 2, lang: str = "lang", text: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top_k collocations. share: one row of so many is in the sample."""
    counts = count_phrases(docs, max_words, min_count, share, sample_count, lang, text)
    size = F.size("keys")
    parts = counts.where(size > 0).select("keys", "n")
    candidates = counts.where(size > 1).select("keys", F.col("n").alias("a"))
    words = counts.where(size == 1).select(F.get("keys", F.lit(0)).alias("key"), "lang", "word")
    totals = counts.where(size == 0).groupBy("lang").agg(F.sum("n").alias("n"))

    cut = candidates.select("keys", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "keys", "a", "k", F.slice("keys", F.lit(1), F.col("k")).alias("head"), F.slice("keys", F.col("k") + 1, size - F.col("k")).alias("tail")
    )
    heads, tails = (parts.select(F.col("keys").alias(c), F.col("n").alias(n)) for c, n in (("head", "l"), ("tail", "r")))
    big = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cut.join(heads, "head").join(tails, "tail").select(
        "keys", "a", "k", "l", "r", (big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)")).alias("num"), (big("l") * big("r")).alias("den")
    )
    least = scored.groupBy("keys", "a").agg(F.min(F.struct(F.expr("num div den").alias("score"), "k", "l", "r")).alias("c"))

    inner = candidates.where(size > 2).select(F.col("a").alias("longer"), "keys", F.explode(F.sequence(F.lit(2), size - 1)).alias("m")).select(
        "longer", "keys", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("from")
    ).select("longer", F.slice("keys", F.col("from"), F.col("m")).alias("keys")).groupBy("keys").agg(F.max("longer").alias("longer"))
    kept = least.join(inner, "keys", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))

    spelled = kept.select("keys", "a", "c.score", "c.l", "c.r", F.posexplode("keys").alias("at", "key")).join(words, "key").groupBy(
        "keys", "a", "score", "l", "r"
    ).agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
