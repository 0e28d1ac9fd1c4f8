"""Interpolated modified Kneser-Ney language model, counted in Spark and stored as sorted hash arrays.

Tokens are words (A-Z in lower case) and one end per text, as 64-bit hashes; n-grams of two words or more have 64-bit keys made of them.
n-grams are counted over all training texts, and continuation counts, the three discounts of each order and the back-off weights come from
all of them. The probability that the unigram discounts free is dealt out evenly to all words and one unknown word.

Every word and every n-gram of the training texts is stored; none is dropped. The hash of the first word chooses the bucket of an n-gram
(all its words, where the first has the share `hot` of all tokens or begins the text, so that no bucket holds all that follows a frequent word).
A task counts its texts by chunks and packs each chunk's counts by bucket; one task per bucket adds them up and writes two files to the shared
folder: sorted keys, and the counts beside them. It sends on what the next lower order needs: a continuation for each n-gram's suffix, and for
each prefix its total and the numbers of its successors seen once, twice and more often. All orders are one chain of shuffles; the driver
receives one row of totals per bucket and order, and the words of the share `hot`, at most 1 / hot per bucket.

Scoring has no shuffle. A worker takes a slice of texts, sorts the keys it needs, and searches them bucket by bucket in the mapped files,
which it maps one at a time. The folder must be mounted on all machines: spark.checkpoint.dir with a file: address, or `folder`. Files have
fixed names and are put in place whole, so that a task that runs again writes the same. They stay as long as the model is needed.

A null text is the empty text: one end token. Rows with a null id are scored and not held out, and not learned from. Repeated
rows count each and get their score each. With no training text, all words are unknown and base scores follow the formula with
zero counts. Empty tables give empty results. A text is a row and is held whole, however long.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import shared_dir, slices

#: Share of all tokens from which on the n-grams that begin with a word are dealt over all buckets.
HOT = 1e-3
END = np.uint64(0x00E5D0F7E87)  # stands for the end token among the word hashes
BEGIN = np.uint64(0x00BE610F7E87)  # stands for what precedes a text
#: Tokens that a task counts at a time, tokens per bucket on average, and words whose hashes a worker remembers.
CHUNK, PER_BUCKET, MAX_REMEMBERED = 3_000_000, 3_000_000, 400_000
#: Bytes of text that are read, and scored, at a time.
READ_BYTES, SCORE_BYTES = 2_000_000, 12_000_000
#: Level of the words' own counts, and of the rows of totals; level k >= 1 holds the n-grams of k words.
WORDS, TOTALS = 0, -1
BLOCKS = "bucket int, level int, block binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, and the end. bytes.lower() and bytes.split() know ASCII letters and white space only."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of several texts in one array, the start of each text, and each token's position in its text."""
    parts = [token_hashes(x) for x in texts]
    sizes = np.array([len(x) for x in parts])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(parts)
    return flat, starts, np.arange(len(flat)) - np.repeat(starts, sizes)


def gram(ids: np.ndarray, order: int, place: np.ndarray, begin: int) -> list[np.ndarray]:
    """The n-gram that ends at each token, as columns from first to last; `begin` fills up the front of a text."""
    line = np.concatenate([np.full(order - 1, begin, ids.dtype), ids])
    return [np.where(place >= order - 1 - k, line[k : k + len(ids)], begin).astype(ids.dtype) for k in range(order)]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def entry_keys(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of n-grams given as columns of word hashes; a single word is its hash."""
    key = columns[0]
    for column in columns[1:]:
        key = _scrambled(_scrambled(key + np.uint64(0x9E3779B97F4A7C15)) ^ column)
    return key


def buckets_of(columns: list[np.ndarray], keys: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each n-gram: by its first word, or by its key where that is a hot word."""
    by = columns[0] if len(columns) == 1 else np.where(np.isin(columns[0], hot), keys, columns[0])
    return ((_scrambled(by) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def discounts(n: list[int]) -> list[float]:
    """The discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams of counts 1 to 4."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), float(k)) if n[k - 1] else k * y for k in (1, 2, 3)]


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned arrays of any lengths in one compressed block, byte by byte of all values."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], np.int64)
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.compress(head.tobytes() + b"".join(planes), 1)


def _unpack(block: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.decompress(block), np.uint8)
    count = int(data[:8].view(np.int64)[0])
    head = data[8 : 8 + 16 * count].view(np.int64).reshape(count, 2)
    out, at = [], 8 + 16 * count
    for width, size in head.tolist():
        planes = data[at : at + width * size].reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(-1))
        at += width * size
    return out


def _merged(size: int, ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows with equal ids (numbers below `size`) become one, with the sums of their values; sorted by ids."""
    code = ids[0].astype(np.int64)
    for k, column in enumerate(ids[1:]):
        if k:  # two numbers below 2**31 fit in 63 bits, three may not
            code = np.unique(code, return_inverse=True)[1]
        code = code * size + column
    _, at, row = np.unique(code, return_index=True, return_inverse=True)
    return [c[at] for c in ids], [np.bincount(row, weights=v, minlength=len(at)).astype(np.int64) for v in values]


def _dealt(level: int, words: np.ndarray, ids: list[np.ndarray], values: list[np.ndarray], hot: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows sorted by ids, packed by bucket: hashes of the words, each column as numbers of them, the values."""
    columns = [words[c] for c in ids]
    bucket = buckets_of(columns, entry_keys(columns), hot, buckets)
    order = np.argsort(bucket, kind="stable")
    chosen, starts = np.unique(bucket[order], return_index=True)
    for b, rows in zip(chosen.tolist(), np.split(order, starts[1:]), strict=True):
        used, local = np.unique(np.concatenate([c[rows] for c in ids]), return_inverse=True)
        local = local.reshape(len(ids), -1)
        numbers = [np.diff(local[0], prepend=0), *local[1:]]  # the first column never falls
        yield b, level, _pack([words[used], *map(_small, numbers), *[_small(v[rows]) for v in values]])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, level, block = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(level, pa.int32()), pa.array(block, pa.binary())], names=["bucket", "level", "block"])


def _counted(texts: DataFrame, level: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """Packed counts of the n-grams of `level` words (WORDS: of the words) of chunks of texts."""
    order = max(1, level)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        flat, place = (np.concatenate(x) for x in zip(*held, strict=True))
        words, ids = np.unique(np.append(flat, BEGIN), return_inverse=True)
        begin, ids = int(ids[-1]), ids[:-1].astype(np.int32)
        ids, n = _merged(len(words), gram(ids, order, place, begin), [np.ones(len(ids))])
        return _batch(list(_dealt(level, words, ids, n, hot, buckets)))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", READ_BYTES):
                if len(part):
                    flat, _, place = joined(part.column("text").to_pylist())
                    held.append((flat, place))
                    size += len(flat)
                if size >= CHUNK:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return texts.mapInArrow(run, BLOCKS)


def _read(blocks: list[bytes], columns: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The rows of packed blocks together: words, merged columns of numbers, summed values."""
    parts = [_unpack(x) for x in blocks]
    words, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    offsets = np.cumsum([0, *(len(p[0]) for p in parts)])
    number = number.astype(np.int32)
    ids = []
    for k in range(columns):
        local = [np.cumsum(p[1], dtype=np.int64) if k == 0 else p[1 + k] for p in parts]
        ids.append(np.concatenate([number[o : o + len(p[0])][x] for o, p, x in zip(offsets, parts, local, strict=False)]))
    values = [np.concatenate([p[k] for p in parts]) for k in range(1 + columns, len(parts[0]))]
    ids, values = _merged(len(words), ids, values)
    return words, ids, values


def _store(folder: str, level: int, bucket: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
    """Sorted keys and their values (a row each), put in place whole."""
    order = np.argsort(keys)
    wide = any(len(v) and int(v.max()) >= 1 << 32 for v in values)
    table = np.stack(values, 1).astype(np.uint64 if wide else np.uint32)[order]
    os.makedirs(folder, exist_ok=True)
    for kind, array in (("values", table), ("keys", keys[order])):
        scratch = f"{folder}/.{uuid.uuid4().hex}"
        with open(scratch, "wb") as file:
            np.save(file, array)
        os.replace(scratch, f"{folder}/{level}-{bucket}-{kind}.npy")


def _added_up(blocks: DataFrame, level: int, highest: bool, folder: str, hot: np.ndarray, buckets: int, share: float = HOT) -> DataFrame:
    """Stores each bucket of a level; returns its row of totals, those that came along, and the blocks of the level below."""

    def add(bucket: int, held: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        order = max(1, level)
        words, ids, values = _read(held, order)
        n = values[0]
        keys = entry_keys([words[c] for c in ids])
        _store(folder, level, bucket, keys, values)
        found = n > 0  # the others are contexts only
        of = [int((n == k).sum()) for k in range(1, 5)]
        totals = [level, bucket, *of, int(found.sum()), int(n.sum())]
        if level == WORDS:
            often = n >= share * n.sum()
            totals += [x for pair in zip(words[ids[0][often]].view(np.int64).tolist(), n[often].tolist(), strict=True) for x in pair]
        yield bucket, TOTALS, np.array(totals, np.int64).tobytes()
        if level < 2:
            return
        ids, n = [c[found] for c in ids], n[found]
        none, one = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
        below = [np.concatenate([first, later]) for first, later in zip(ids[:-1], ids[1:], strict=True)]
        sums = [(none, one), (n, none), (n == 1, none), (n == 2, none), (n > 2, none)]
        below, sums = _merged(len(words), below, [np.concatenate(x) for x in sums])
        yield from _dealt(level - 1, words, below, sums, hot, buckets)

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            yield _batch([r for r in rows if r[1] == TOTALS])
            for bucket, kind, block in rows:
                if kind != TOTALS:
                    held.setdefault(bucket, []).append(block)
        for bucket in sorted(held):
            yield _batch(list(add(bucket, held.pop(bucket))))

    return blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(run, BLOCKS)


def mounted(folder: str) -> str:
    """The path of a folder that workers can map files of."""
    address = urlparse(folder)
    if address.scheme not in ("", "file"):
        raise ValueError(f"{folder}: the model's files are mapped into memory; name a mounted folder that all machines share")
    return unquote(address.path) if address.scheme else folder


@dataclass
class Model:
    """Where the arrays of a fitted model are, and its totals."""

    order: int
    folder: str
    hot: np.ndarray
    buckets: dict[int, int]  # by level
    filled: dict[int, frozenset[int]]  # by level: the buckets that have files
    drop: dict[int, list[float]]  # by level: the discounts
    total: int  # training tokens
    distinct: int  # distinct training tokens
    continuations: int  # the sum of the counts of level 1
    unknown: float  # probability of an unknown word

    def find(self, level: int, columns: list[np.ndarray], width: int) -> np.ndarray:
        """The stored values (`width` each) of n-grams, given as columns of word hashes without repeats; zeros where there are none."""
        keys = entry_keys(columns)
        out = np.zeros((len(keys), width))
        bucket = buckets_of(columns, keys, self.hot, self.buckets[level])
        order = np.lexsort((keys, bucket))
        chosen, starts = np.unique(bucket[order], return_index=True)
        for b, rows in zip(chosen.tolist(), np.split(order, starts[1:]), strict=True):
            if b not in self.filled[level]:
                continue
            stored, values = (np.load(f"{self.folder}/{level}-{b}-{kind}.npy", mmap_mode="r") for kind in ("keys", "values"))
            wanted = keys[rows]
            at = np.searchsorted(stored, wanted)
            at[at == len(stored)] = 0
            there = stored[at] == wanted
            out[rows[there]] = values[at[there]]
        return out

    def off(self, level: int, n: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        return n - np.array([0.0, *self.drop[level]])[np.minimum(n, 3).astype(np.int64)]

    def tokens(self, flat: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its count in training and its probability after its predecessors."""
        words, ids = np.unique(np.append(flat, BEGIN), return_inverse=True)
        begin, ids = int(ids[-1]), ids[:-1]
        counts = self.find(WORDS, [words], 1)[ids, 0]
        below = self.find(1, [words], 1 if self.order == 1 else 5)  # the level below, by the number of its n-gram
        p = (self.off(1, below[:, 0]) / self.continuations if self.continuations else 0.0 * below[:, 0]) + self.unknown
        p, numbers, size = p[ids], ids, len(words)
        context = np.where(place >= 1, np.concatenate([[begin], ids[:-1]]), begin)  # rows of below
        for k in range(2, self.order + 1):
            # A token's k-gram is its context and itself.
            columns = gram(ids, k, place, begin)
            _, at, row = np.unique(context.astype(np.int64) * len(words) + ids, return_index=True, return_inverse=True)
            grams = [words[c[at]] for c in columns]
            stored = self.find(k, grams, 1 if k == self.order else 5)
            t, *seen = (below[context, j] for j in range(1, 5))
            rest = sum(d * x for d, x in zip(self.drop[k], seen, strict=True))
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(t > 0, (self.off(k, stored[row, 0]) + rest * p) / t, p)
            if k < self.order:
                # The next context is the k-gram of the token before, or begins the text.
                starts = [words[np.full(1, begin)] for _ in range(k)]
                below = np.concatenate([stored, self.find(k, starts, 5)])
                context = np.where(place >= 1, np.concatenate([[len(stored)], row[:-1]]), len(stored))
        return counts, p


def fit(train: DataFrame, order: int = 2, text: str = "text", hot: float = HOT, per_bucket: int = PER_BUCKET, folder: str | None = None) -> Model:
    """The model of all texts of train; per_bucket is the number of training tokens per bucket on average."""
    spark = train.sparkSession
    folder = mounted(folder or shared_dir(spark))
    texts = train.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def totals(blocks: DataFrame) -> list[list[int]]:
        return [np.frombuffer(x, np.int64).tolist() for x in blocks.where(F.col("level") == TOTALS).toArrow()["block"].to_pylist()]

    none = np.array([BEGIN])
    buckets = {WORDS: max(8, math.ceil(size / (8 * per_bucket)))}
    found = totals(_added_up(_counted(texts, WORDS, none, buckets[WORDS]), WORDS, True, folder, none, buckets[WORDS], hot))
    filled = {WORDS: frozenset(x[1] for x in found)}
    distinct, total = (sum(x[k] for x in found) for k in (6, 7))
    words, counts = (np.array([v for x in found for v in x[8 + k :: 2]], np.int64) for k in (0, 1))
    hot_words = np.append(words[counts >= hot * total].view(np.uint64), BEGIN)

    many = max(8, math.ceil(total / per_bucket))
    blocks = _counted(texts, order, hot_words, many)
    for k in range(order, 0, -1):
        blocks = _added_up(blocks, k, k == order, folder, hot_words, many)
    found = totals(blocks)
    drop, sums = {}, {}
    for k in range(1, order + 1):
        level = [x for x in found if x[0] == k]
        buckets[k], filled[k] = many, frozenset(x[1] for x in level)
        of = [sum(x[j] for x in level) for j in range(2, 6)]
        drop[k] = discounts(of)
        sums[k] = (of, sum(x[6] for x in level), sum(x[7] for x in level))
    of, kinds, continuations = sums[1]
    freed = sum(d * n for d, n in zip(drop[1], (of[0], of[1], kinds - of[0] - of[1]), strict=True))
    unknown = (freed / continuations if continuations else 1.0) / (distinct + 1)
    return Model(order, folder, hot_words, buckets, filled, drop, total, distinct, continuations, unknown)


def score(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """Every row: keys, n_tokens, n_known, base_score, score (log10)."""
    base_all = math.log10(model.total + 0.5 * (model.distinct + 1))
    rows = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    fields = "".join(f"`{k}` {t}, " for k, t in rows.dtypes[:-1])
    names = [*keys, "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", SCORE_BYTES):
                if not len(part):
                    continue
                flat, starts, place = joined(part.column("__text").to_pylist())
                counts, p = model.tokens(flat, place)
                each = lambda values: pa.array(np.add.reduceat(values, starts))
                sums = each(np.ones(len(flat), np.int64)), each((counts > 0).astype(np.int64)), each(np.log10(counts + 0.5) - base_all), each(np.log10(p))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *sums], names=names)

    return rows.mapInArrow(run, f"{fields}n_tokens long, n_known long, base_score double, score double")
