"""Byte-level BPE encoding and decoding.

Texts are cut by a pattern and each piece is merged by itself. Live tokens of a piece form a linked list over its
byte positions; a segment tree over the positions holds, at each live position, the rank of the pair that begins
there (with the position, so that the least value is the leftmost pair of least rank). A merge takes the root,
joins two neighbours and updates two or three leaves, each in logarithmic time, so a piece of n bytes without a space takes
n log n steps, whatever its length. A piece that is itself a vocabulary entry is that one token.

Pieces repeat, so each task keeps the ids of recent pieces in a bounded table; that changes the speed only. Rows are
independent: nothing is shuffled, and a lost task is computed again. The vocabulary (a file of ranks, its size checked) is
read by the driver and sent to the workers with the function.

A null text is the empty text: no ids, empty bytes. Ids beyond the vocabulary raise an error in decode(). Repeated rows each
get their own result; empty tables give empty results.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import map_slices

#: A vocabulary file may have this many bytes, as it is sent to every task.
MAX_VOCABULARY_BYTES = 64_000_000
#: Pieces whose ids a task remembers; the table is emptied when full.
MAX_REMEMBERED = 500_000
#: Longer pieces are not remembered.
MAX_REMEMBERED_LENGTH = 64
#: Ids that are decoded together.
DECODED_IDS = 1_000_000
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings and ranks of a rank file: lines of base64 and a number."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << (n - 1).bit_length()
    shift = n.bit_length()
    mask = (1 << shift) - 1
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank << shift | i
    for k in range(leaves - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    after = list(range(1, n + 2))  # where the token at a live position ends, and the next begins
    before = list(range(-1, n))
    while (least := tree[1]) < _NONE:
        i = least & mask
        gone = after[i]
        after[i] = end = after[gone]
        changed = [(gone, None), (i, None)]
        if end < n:
            before[end] = i
            changed[1] = (i, rank_of(piece[i : after[end]]))
        ahead = before[i]
        if ahead >= 0:
            changed.append((ahead, rank_of(piece[ahead:end])))
        for at, rank in changed:
            k = leaves + at
            value = tree[k] = _NONE if rank is None else rank << shift | at
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    ids, i = [], 0
    while i < n:
        end = after[i]
        ids.append(ranks[piece[i:end]])
        i = end
    return ids


class Encoder(dict):
    """Ids by piece (a str), as packed 32-bit numbers, filled on demand and bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", merge_piece(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= MAX_REMEMBERED_LENGTH:
            if len(self) >= MAX_REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


_encoders: dict[str, Encoder] = {}


def _encoder(digest: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker's encoder of a vocabulary and pattern; its remembered pieces serve all slices and later tasks."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(ranks, pattern)
    return _encoders[digest]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys and token_ids (array<int>) of the whole text of every row."""
    rows = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1])
    digest = xxhash.xxh3_128_hexdigest(repr((pattern, sorted(ranks.items()))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(digest, ranks, pattern)
        packed = [encoder.packed(x) if x else b"" for x in batch.column("__text").to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*keys, "token_ids"])

    return map_slices(rows, run, f"{fields + ', ' if fields else ''}token_ids array<int>", "__text")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids") -> DataFrame:
    """All columns and decoded (binary): the bytes of the ids, in order. Null ids are no ids."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    every = np.frombuffer(b"".join(tokens), np.uint8)
    sizes = np.array([len(x) for x in tokens], np.int32)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    fields = ", ".join(f"`{k}` {t}" for k, t in encoded.dtypes)

    def texts(lists: pa.ListArray) -> pa.Array:
        """The bytes of each list, gathered from one buffer of all tokens."""
        flat, counts = np.asarray(lists.flatten()), np.asarray(lists.value_lengths().fill_null(0))
        if len(flat) and flat.min() < 0:
            raise IndexError("a token id is negative")
        each = sizes[flat]
        ends = np.cumsum(each, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(starts[flat] - (ends - each), each)
        places += np.arange(total)
        edges = np.append(0, ends)[np.append(0, np.cumsum(counts))].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edges), pa.py_buffer(every[places])])

    def run(batches):
        for batch in batches:
            counts = np.asarray(batch.column(ids).value_lengths().fill_null(0))
            piece = np.cumsum(counts, dtype=np.int64) // DECODED_IDS  # rows of about so many ids at a time
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, texts(part.column(ids))], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
