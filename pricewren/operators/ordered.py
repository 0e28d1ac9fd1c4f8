"""Running sums, ordinals, global ranks and nearest-value joins for keys of any size (rows W2, W4, O1-O4, R2, X11).

A window function puts all rows of its key into one task.  Here rows are dealt by
ranges of key *and* order instead, so a key that holds a third of the table lies in
a third of the tasks.  Each task sums its own sorted rows; what the tasks before it
hold of its first key is a sum over one small row per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pricewren.session import staged

_SEED = 0x0DD


def _identity(keys: Sequence[str]) -> list[Column]:
    """Two independent hashes of the key; nulls are told apart from missing columns."""
    parts = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    return [F.xxhash64(F.lit(0), *parts).alias("_ka"), F.xxhash64(F.lit(_SEED), *parts).alias("_kb")]


def _local_sums(names: Sequence[str]):
    """Running sums per key over the sorted rows of one partition, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, carried = TaskContext.get().partitionId(), 0, None, [0] * len(names)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            a, b = (np.asarray(batch.column(k)) for k in ("_ka", "_kb"))
            new = np.ones(size, bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[0] = (a[0], b[0]) != last
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            sums = {}
            for i, name in enumerate(names):
                value = np.asarray(batch.column(name))
                total = np.cumsum(value)
                base = np.append(total[starts] - value[starts], -carried[i])  # group -1 goes on from the batch before
                sums[name] = total - base[group]
                carried[i] = int(sums[name][-1])
            last = (a[-1], b[-1])
            columns = [pa.array(sums[c]) if c in sums else x for c, x in zip(batch.schema.names, batch.columns, strict=True)]
            places = [pa.array(np.full(size, part, np.int32)), pa.array(np.arange(at, at + size))]
            at += size
            yield pa.RecordBatch.from_arrays([*columns, *places], names=[*batch.schema.names, "_part", "_at"])

    return run


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Mapping[str, Column]) -> DataFrame:
    """``df`` with a running sum (the row included) of every value within its key.

    ``keys`` may be empty.  ``order`` should decide between any two rows of a key;
    rows that it leaves equal come in any order, and only one task can hold them.
    The sums are exact 64-bit integers; null values count as 0 and columns of the
    same names are replaced.  The sorted rows are written to the shared folder once.
    """
    names, spark = list(values), df.sparkSession
    rows = df.withColumns({n: F.coalesce(v.cast("long"), F.lit(0)).cast("long") for n, v in values.items()})
    rows = rows.select("*", *_identity(keys))
    by = [*[F.col(k) for k in keys], *order]
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, *by).sortWithinPartitions(*by) if by else rows.repartition(count)
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])
    local = staged(ranged.mapInArrow(_local_sums(names), schema), "running")

    # One row per partition: its last key and what it holds of it.  A key goes on at the first row of the next partition.
    tails = local.groupBy("_part").agg(F.max_by(F.struct("_ka", "_kb", *names), "_at").alias("tail")).orderBy("_part").collect()
    offsets, held = [], None
    for row, following in pairwise([*tails, None]):
        key, sums = tuple(row["tail"][:2]), list(row["tail"][2:])
        if held is not None and held[0] == key:
            sums = [x + y for x, y in zip(sums, held[1], strict=True)]
        held = (key, sums)
        if following is not None:
            offsets.append((following["_part"], *key, *sums))
    carried = spark.createDataFrame(offsets, ", ".join(["_part int", "_ka long", "_kb long", *[f"_carry_{i} long" for i in range(len(names))]]))
    joined = local.join(F.broadcast(carried), ["_part", "_ka", "_kb"], "left")
    total = {n: F.col(n) + F.coalesce(F.col(f"_carry_{i}"), F.lit(0)) for i, n in enumerate(names)}
    return joined.select(*[total[c].alias(c) if c in total else F.col(c) for c in rows.columns if c not in ("_ka", "_kb")])


def with_ordinal(df: DataFrame, keys: Sequence[str], *order: Column | str, name: str = "ordinal") -> DataFrame:
    """1-based position within the key (64 bits, as a key may have any number of rows)."""
    return running_totals(df, keys, order, {name: F.lit(1)})


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """1-based position in a global order, collated orders included."""
    return running_totals(df, [], order, {name: F.lit(1)})


def nearest_join(rows: DataFrame, references: DataFrame, keys: Sequence[str], *, value: str, reference: str, order: str,
                 keep: Sequence[str] = ()) -> DataFrame:
    """R2 against a table: for every row the reference of its key with the closest value.

    Adds ``nearest_<column>`` for ``reference``, ``order`` and the ``keep`` columns of
    the references, and ``diff``.  Ties go to the smaller ``order`` (which must be
    unique within a key).  Rows without a value or a key, or whose key has no
    reference, get nulls; references without a value don't count.

    Rows and references are sorted together; the running count of references tells
    every row the last reference that isn't above it, and hence the next one.  One
    equi join on (key, count) then fetches both: no pairs are compared, however many
    references a key has, and crowded counts are joins that Spark splits at run time.
    """
    keys, kept = list(keys), [reference, order, *keep]
    best = references.filter(F.col(reference).isNotNull()).groupBy(*keys, reference).agg(
        F.min(F.struct(order, *keep)).alias("_r")
    ).select(*keys, F.col(reference).cast("double").alias("_v"), F.struct(F.col(reference), F.col(f"_r.{order}"), *[F.col(f"_r.{c}") for c in keep]).alias("_ref"))
    facts = rows.select(*keys, F.col(value).cast("double").alias("_v"), F.struct(*rows.columns).alias("_row"))
    both = facts.withColumn("_ref", F.lit(None).cast(best.schema["_ref"].dataType)).unionByName(
        best.withColumn("_row", F.lit(None).cast(facts.schema["_row"].dataType))
    )
    spread = F.xxhash64("_row")
    counted = running_totals(both, keys, [F.asc_nulls_first("_v"), F.col("_ref").isNull(), spread], {"_n": F.col("_ref").isNotNull().cast("int")})
    numbered = counted.filter("_ref is not null").select(*keys, "_n", "_ref")
    below = numbered.withColumnRenamed("_ref", "_below")
    above = numbered.withColumns({"_n": F.col("_n") - 1}).withColumnRenamed("_ref", "_above")
    sides = below.join(above, [*keys, "_n"], "full")
    joined = counted.filter("_row is not null").drop("_ref").join(sides, [*keys, "_n"], "left")

    def candidate(side: str) -> Column:
        diff = F.abs(F.col("_v") - F.col(f"{side}.{reference}").cast("double"))
        return F.when(diff.isNotNull(), F.struct(diff.alias("diff"), F.col(f"{side}.{order}").alias("o"), F.col(side).alias("ref")))

    near = F.least(candidate("_below"), candidate("_above"))
    out = joined.withColumn("_near", near)
    return out.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in rows.columns],
        *[F.col(f"_near.ref.{c}").alias(f"nearest_{c}") for c in kept], F.col("_near.diff").alias("diff"),
    )


# --- ranges -------------------------------------------------------------------
def _nodes(first: Column, last: Column, level: Column) -> Column:
    """The dyadic nodes of one level that the range ``first..last`` is made of (two at most).

    Level k cuts the integers into blocks of 2**k.  From the bottom up, a block at
    the left edge is taken where its number is odd, one at the right edge likewise.
    """
    size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    low = F.call_function("shiftright", first + size - 1, level)
    high = F.call_function("shiftright", last + 1, level)
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    node = lambda x: F.struct(level.alias("level"), x.alias("block"))
    open_ = low < high
    return F.array_compact(F.array(F.when(open_ & odd(low), node(low)), F.when(open_ & odd(high), node(high - 1))))


#: Levels of the dyadic blocks; ranges and points may be anything up to 2**LEVELS either side of 0.
LEVELS = 61


def range_join(rows: DataFrame, ranges: DataFrame, *, point: str, first: str, last: str, order: Sequence[str], take: Sequence[str],
               how: str = "left") -> DataFrame:
    """Every row with the first range (by ``order``) whose ``first..last`` holds its point.

    Which range is first changes only at borders, the places where one begins or the
    place after its end.  The first range of every border comes from dyadic blocks: a range is
    cut into at most two a level (2 log n rows, whatever its width), a border lies in one a level and
    probes those that occur by an equi join.  Points and borders are then sorted together; the running
    count of borders tells every point the last one that isn't above it, and one equi join fetches
    its range.  So a point is one row whatever the levels; points are reduced to distinct values before.
    Adds the ``take`` columns of the range.  Null points and ranges with a null or reversed border match nothing.
    """
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    a, b = F.col(first).cast("long"), F.col(last).cast("long")
    best = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"t{i}") for i, c in enumerate(take)])
    blocks = (
        ranges.filter(a <= b).select(best.alias("_range"), F.explode(F.flatten(F.transform(levels, lambda k: _nodes(a, b, k)))).alias("_node"))
        .groupBy("_node.level", "_node.block").agg(F.min("_range").alias("_range"))
    )
    blocks = staged(blocks, "blocks")
    used = sorted(r["level"] for r in blocks.select("level").distinct().collect())
    values = rows.select(F.col(point).alias("_point")).filter("_point is not null").distinct()
    if not used:
        found = values.limit(0).withColumn("_range", F.lit(None).cast(blocks.schema["_range"].dataType))
    else:
        ends = ranges.filter(a <= b).select(F.explode(F.array(a, F.when(b < (1 << 63) - 1, b + 1))).alias("_place")).filter("_place is not null").distinct()
        probes = ends.select("_place", F.explode(F.array(*[
            F.struct(F.lit(k).alias("level"), F.shiftright("_place", k).alias("block")) for k in used
        ])).alias("_node")).select("_place", "_node.*")
        first_of = probes.join(blocks, ["level", "block"], "left").groupBy("_place").agg(F.min("_range").alias("_range"))
        borders = staged(first_of, "borders").withColumn("_point", F.lit(None).cast(values.schema["_point"].dataType)).withColumn("_border", F.lit(1))
        placed = values.select(F.col("_point").cast("long").alias("_place"), F.lit(None).cast(blocks.schema["_range"].dataType).alias("_range"), "_point", F.lit(0).alias("_border"))
        counted = running_totals(borders.unionByName(placed.filter("_place is not null")), [], [F.col("_place"), F.desc("_border")], {"_n": F.col("_border")})
        segments = counted.filter("_border = 1 and _range is not null").select("_n", "_range")
        found = counted.filter("_border = 0").select("_n", "_point").join(segments, "_n").select("_point", "_range")
    joined = rows.join(found, F.col(point) == F.col("_point"), how)
    return joined.select(*[rows[c] for c in rows.columns], *[F.col(f"_range.t{i}").alias(c) for i, c in enumerate(take)])
