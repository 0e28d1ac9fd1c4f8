"""Hard negatives of anchors by angular triangle filtering.

A row is a vector of integers (each component is floor(scale * x)) with a label; a score is the integer inner product with an
anchor. For each anchor, its best rows of the same label are its positives; for each positive, the best rows of other labels
whose score is between low and high percent of the positive's are returned.

1. Every row's norm and its angles to REFERENCES directions are stored with it. The directions are rows of a sample of at most SAMPLE
   rows (the first by a hash of the id), chosen one by one as far as possible from those before.
2. Anchors go through in slabs of at most slab_bytes, in one pass over the rows each: a slab is broadcast, so its size is bounded
   whatever the number of anchors, and no vector is shuffled. In a task, rows are compared in tiles.
3. For an anchor and a row, every direction gives an interval of their angle: |a - b| <= angle <= min(a + b, 2 pi - a - b). The
   cosines of the narrowest interval, times both norms, bound the score; angles are widened by more than their rounding error and
   bounds by one unit and a share of the norms, so they are safe. Only pairs whose bounds reach the anchor's present
   worst positive, or overlap the window of one of its positives, are scored.
4. A task returns at most `positives` rows an anchor, or `negatives` rows an anchor and positive; the best of all tasks are ranked by Spark.

Scores are exact: by floating point where no product sum can pass 2**53, by Python integers else; beyond 64 bits they saturate.

Rows with a null id, label or vector, or with a null or non-finite component (also after scaling), take no part. Shorter vectors are filled up with
zeros. Rows that share an id are one row: the least by label and vector. Ties go to the smaller id. An anchor without positives, or a
positive without rows in its window (or with a negative score), has no rows. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewren.llm.common import staged

REFERENCES, SAMPLE = 12, 512
#: Rows and anchors of a tile.
TILE_ROWS, TILE_ANCHORS = 4096, 256
#: Angles of float64 vectors are right within this.
ANGLE_ERROR = 1e-6
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of floats as a matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(column.flatten())
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms; rows are scaled by their largest component, so that nothing overflows."""
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return top * np.sqrt(np.square(x / safe[:, None]).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0)
    x = x / np.where(top > 0, top, 1.0)[:, None]
    norm = np.sqrt(np.square(x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1.0)[:, None]


def angles(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ references.T, -1.0, 1.0))


def score_bounds(angles_a: np.ndarray, norms_a: np.ndarray, angles_b: np.ndarray, norms_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of a against b."""
    near = np.zeros((len(angles_a), len(angles_b)))
    far = np.full(near.shape, math.pi)
    for k in range(angles_a.shape[1]):
        a, b = angles_a[:, k, None], angles_b[None, :, k]
        np.maximum(near, np.abs(a - b), out=near)
        both = a + b
        np.minimum(far, np.minimum(both, 2 * math.pi - both), out=far)
    size = norms_a[:, None] * norms_b[None, :]
    slack = 1e-9 * size + 1
    low = size * np.cos(np.minimum(far + ANGLE_ERROR, math.pi)) - slack
    high = size * np.cos(np.maximum(near - ANGLE_ERROR, 0.0)) + slack
    return low, high


def _exact(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, row of b and score of the wanted pairs."""
    at_a, at_b = np.nonzero(wanted)
    if not len(at_a):
        return at_a, at_b, np.empty(0, np.int64)
    if a.shape[1] * np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) < 2.0**53:
        if 8 * len(at_a) > wanted.size:  # most of the tile: one product of matrices
            return at_a, at_b, (a @ b.T)[at_a, at_b].astype(np.int64)
        return at_a, at_b, np.einsum("ij,ij->i", a[at_a], b[at_b]).astype(np.int64)
    found = [sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True)) for i, j in zip(at_a, at_b, strict=True)]
    return at_a, at_b, np.array([min(max(x, _LEAST), _MOST) for x in found], np.int64)


class _Best:
    """The best k (score descending, id ascending) of each slot."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.score, self.id = np.full((slots, k), _LEAST), np.full((slots, k), _MOST)
        self.used = np.zeros((slots, k), bool)

    def worst(self) -> np.ndarray:
        """The score that a further row must reach; the least number where a slot has room."""
        return np.where(self.used[:, -1], self.score[:, -1], _LEAST)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.worst()[slot]
        slot, score, ids = slot[keep], score[keep], ids[keep]
        if not len(slot):
            return
        touched = np.unique(slot)
        held_at, held_k = np.nonzero(self.used[touched])
        held = touched[held_at]
        slot = np.concatenate([slot, held])
        score = np.concatenate([score, self.score[held, held_k]])
        ids = np.concatenate([ids, self.id[held, held_k]])
        order = np.lexsort((ids, -np.maximum(score, _LEAST + 1), slot))
        slot, score, ids = slot[order], score[order], ids[order]
        head = np.searchsorted(slot, slot, side="left")
        rank = np.arange(len(slot)) - head
        top = rank < self.k
        self.used[touched] = False
        self.score[slot[top], rank[top]], self.id[slot[top], rank[top]] = score[top], ids[top]
        self.used[slot[top], rank[top]] = True

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, k = np.nonzero(self.used)
        return slot, self.score[slot, k], self.id[slot, k]


class _Slab:
    """Anchors of one pass: ids, labels, vectors, norms, angles, and per anchor the scores of its positives."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.id, self.label = table["id"].to_numpy(), table["label"].to_numpy()
        self.vector, self.norm = _matrix(table["vector"], width), table["norm"].to_numpy()
        self.angles = _matrix(table["angles"], REFERENCES)

    def __len__(self) -> int:
        return len(self.id)


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(start, TILE_ROWS)
            yield (
                np.asarray(part["id"]), np.asarray(part["label"]), _matrix(part["vector"], width),
                np.asarray(part["norm"]), _matrix(part["angles"], REFERENCES),
            )


def prepared(rows: DataFrame, id_col: str, vector: str, label: str, scale: float) -> DataFrame:
    """id, label (long) and vector (whole numbers) of the rows that take part, one per id."""
    whole = F.transform(F.col(vector), lambda x: _floor(x.cast("double") * scale))
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    return out.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


def _floor(x: Column) -> Column:
    """floor as a double of any size: floor() itself gives a long, which holds no double beyond 2**63."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _directions(rows: DataFrame, width: int) -> np.ndarray:
    """Unit vectors far from one another, from a bounded sample of rows; zeros fill up a small table."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    units = _unit(_matrix(sample["vector"], width))
    units = units[np.abs(units).max(axis=1, initial=0.0) > 0]
    out = np.zeros((REFERENCES, width))
    if len(units):
        nearest = np.full(len(units), -2.0)
        at = 0
        for k in range(min(REFERENCES, len(units))):
            out[k] = units[at]
            nearest = np.maximum(nearest, units @ units[at])
            at = int(np.argmin(nearest))
    return out


def _with_angles(rows: DataFrame, references: np.ndarray, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["vector"], width)
            found = pa.array(list(angles(x, references)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_norms(x)), found], names=["id", "label", "vector", "norm", "angles"])

    return rows.select("id", "label", "vector").mapInArrow(run, "id long, label long, vector array<double>, norm double, angles array<double>")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, slab, width: int, k: int) -> DataFrame:
    """anchor, score, other, rank: the best rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = slab.value
        best = _Best(len(anchors), k)
        for ids, labels, vector, norm, angle in _tiles(batches, width):
            for start in range(0, len(anchors), TILE_ANCHORS):
                own = slice(start, start + TILE_ANCHORS)
                wanted = (anchors.label[own, None] == labels[None, :]) & (anchors.id[own, None] != ids[None, :])
                _, high = score_bounds(anchors.angles[own], anchors.norm[own], angle, norm)
                wanted &= ~(high < best.worst()[own].astype(float)[:, None])  # not a number counts as reaching
                at, other, score = _exact(anchors.vector[own], vector, wanted)
                best.add(at + start, score, ids[other])
        slot, score, other = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchors.id[slot]), pa.array(score), pa.array(other)], names=["anchor", "score", "other"])

    return _ranked(rows.mapInArrow(run, "anchor long, score long, other long"), ["anchor"], k)


def _negatives(rows: DataFrame, slab, goals, width: int, k: int) -> DataFrame:
    """anchor, positive, score, other, rank: the best rows of other labels within each positive's window.

    goals: per anchor of the slab and place the positive's id, and the window's bounds (an empty window where there is none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = slab.value
        positive, bottom, top = goals.value
        places = positive.shape[1]
        best = _Best(len(anchors) * places, k)
        for ids, labels, vector, norm, angle in _tiles(batches, width):
            for start in range(0, len(anchors), TILE_ANCHORS):
                own = slice(start, start + TILE_ANCHORS)
                low, high = score_bounds(anchors.angles[own], anchors.norm[own], angle, norm)
                wanted = np.zeros(low.shape, bool)
                need = np.maximum(bottom, best.worst().reshape(-1, places))[own]
                for p in range(places):
                    there = (bottom[own, p] <= top[own, p])[:, None]
                    wanted |= there & ~(high < need[:, p, None].astype(float)) & ~(low > top[own, p, None].astype(float))
                wanted &= anchors.label[own, None] != labels[None, :]
                at, other, score = _exact(anchors.vector[own], vector, wanted)
                for p in range(places):
                    fits = (score >= bottom[own][at, p]) & (score <= top[own][at, p])
                    best.add((at[fits] + start) * places + p, score[fits], ids[other[fits]])
        slot, score, other = best.rows()
        arrays = [anchors.id[slot // places], positive[slot // places, slot % places], score, other]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["anchor", "positive", "score", "other"])

    return _ranked(rows.mapInArrow(run, "anchor long, positive long, score long, other long"), ["anchor", "positive"], k)


def window(positive_score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score s of low * p <= 100 * s <= high * p, without overflow; an empty window where there is none."""
    bounds = [(-(-low * p // 100), high * p // 100) for p in positive_score.tolist()]
    bottom, top = zip(*bounds, strict=True) if bounds else ((), ())
    clipped = [np.array([min(max(x, _LEAST), _MOST) for x in side], np.int64) for side in (bottom, top)]
    return clipped[0], clipped[1]


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, slab_bytes: int = 16_000_000,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: a condition on the column id."""
    spark = rows.sparkSession
    whole = staged(prepared(rows, id_col, vector, label, scale))
    width = whole.agg(F.max(F.size("vector"))).first()[0] or 0
    angled = staged(_with_angles(whole, _directions(whole, width), width))

    # Slabs: anchors are dealt evenly over partitions, and within each by their place.
    most = max(1, slab_bytes // (8 * (width + REFERENCES + 3 + 3 * positives)))
    chosen = angled.where(anchor)
    parts = max(1, math.ceil(chosen.count() / most))
    place = F.monotonically_increasing_id()
    dealt = staged(chosen.repartition(parts, F.xxhash64("id")).withColumn(
        "slab", F.shiftright(place, 33) * F.lit(1 << 32) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / most)
    ))
    out = None
    for (number,) in sorted(dealt.select("slab").distinct().collect()):
        slab = _Slab(dealt.where(F.col("slab") == number).drop("slab").toArrow(), width)
        sent = spark.sparkContext.broadcast(slab)
        best = staged(_positives(angled, sent, width, positives).select("anchor", "rank", F.col("other").alias("positive"), F.col("score").alias("positive_score")))

        held = best.toArrow()
        at = np.argsort(slab.id)
        where = at[np.searchsorted(slab.id, held["anchor"].to_numpy(), sorter=at)]
        rank = held["rank"].to_numpy() - 1
        positive = np.zeros((len(slab), positives), np.int64)
        bottom, top = np.ones_like(positive), np.zeros_like(positive)
        positive[where, rank] = held["positive"].to_numpy()
        bottom[where, rank], top[where, rank] = window(held["positive_score"].to_numpy(), low, high)
        goals = spark.sparkContext.broadcast((positive, bottom, top))

        found = _negatives(angled, sent, goals, width, negatives).join(best.drop("rank"), ["anchor", "positive"])
        part = staged(found.select(
            F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ))
        out = part if out is None else out.unionByName(part)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], empty) if out is None else out
