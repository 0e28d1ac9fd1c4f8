"""Running sums, ranks, nearest values and ranges against plain definitions, with hot keys."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricewren.operators import match, ordered


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    found = [(rnd.choice([None, "a", ""]) if rnd.random() < 0.6 else f"k{rnd.randrange(300)}", i, rnd.choice([None, 0, 1, -5])) for i in range(5000)]
    rnd.shuffle(found)
    return found


def test_running_totals_of_hot_keys(spark, rows):
    df = spark.createDataFrame(rows, "k string, pos long, v int")
    got = {r.pos: (r.s, r.n, r.v) for r in ordered.running_totals(df, ["k"], ["pos"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    held, want = {}, {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        s, n = held.get(k, (0, 0))
        held[k] = (s + (v or 0), n + 1)
        want[pos] = (*held[k], v)
    assert got == want


def test_a_hot_key_is_dealt_over_all_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    staged = {}
    original = ordered.staged

    def kept(df, name):
        staged["df"] = original(df, name)
        return staged["df"]

    ordered.staged = kept
    try:
        ordered.with_ordinal(df, ["k"], "id")
    finally:
        ordered.staged = original
    sizes = sorted(r["count"] for r in staged["df"].groupBy("_part").count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_global_rank_also_in_czech_collation(spark):
    names = ["Chleb", "Hrach", "Cibule", "Cocka", "ch", "h", "i", "c"]
    ranked = ordered.with_rank(spark.createDataFrame([(n,) for n in names], "p string"), F.collate("p", "cs")).collect()
    assert [r.p for r in sorted(ranked, key=lambda r: r["rank"])] == ["c", "Cibule", "Cocka", "h", "Hrach", "ch", "Chleb", "i"]
    down = ordered.with_rank(spark.range(3000), F.desc("id")).collect()
    assert all(r["rank"] == 3000 - r.id for r in down)
    assert ordered.with_rank(spark.range(0), "id").count() == 0


def test_nearest_reference_ties_and_gaps(spark):
    rnd = random.Random(4)
    references = [(rnd.choice(["a", "b"]), float(rnd.randrange(200)), j) for j in range(300)] + [("a", None, 999), (None, 3.0, 1000)]
    facts = [(i, rnd.choice(["a", "b", "zz", None]) if i % 3 else "a", rnd.randrange(-10, 250) / 2 if i % 50 else None) for i in range(2000)]
    facts += [(5000 + i, "a", 7.0) for i in range(1500)]
    df = spark.createDataFrame(facts, "i long, k string, x double")
    got = ordered.nearest_join(df, spark.createDataFrame(references, "k string, y double, o long"), ["k"], value="x", reference="y", order="o")
    assert got.columns == ["i", "k", "x", "nearest_y", "nearest_o", "diff"]
    found = {r.i: (r["diff"], r.nearest_o, r.nearest_y) for r in got.collect()}
    for i, k, x in facts:
        near = [(abs(x - y), o, y) for kk, y, o in references if kk == k and k is not None and y is not None and x is not None]
        assert found[i] == min(near, default=(None, None, None))
    assert len(found) == len(facts)


def test_ranges_of_any_width(spark):
    rnd = random.Random(6)
    ranges = []
    for i in range(200):
        first = rnd.randrange(-3000, 3000)
        ranges.append((first, first + rnd.choice([0, 1, 5, 100, 10**3, 10**6, 10**9, 2**50]), f"c{i}"))
    ranges += [(5, 4, "reversed"), (None, 4, "open")]
    points = [rnd.randrange(-4000, 4000) for _ in range(2000)] + [10**6, 10**9 - 5, 2**40, -(2**40), None] + [7] * 1000
    df = spark.createDataFrame(list(enumerate(points)), "i long, p long")
    table = spark.createDataFrame(ranges, "f long, t long, c string")
    got = {r.i: r.c for r in ordered.range_join(df, table, point="p", first="f", last="t", order=["f", "c"], take=["c"]).collect()}
    for i, p in enumerate(points):
        fits = [(a, c) for a, b, c in ranges if a is not None and p is not None and a <= p <= b]
        assert got[i] == min(fits, default=(0, None))[1]
    none = ordered.range_join(df, table.where("false"), point="p", first="f", last="t", order=["f"], take=["c"])
    assert none.where("c is null").count() == len(points)


def test_anchor_is_the_rarest_gram_and_its_place(spark):
    needles = [("n1", ["red apple pie", "x"]), ("n2", ["red apple tart"]), ("n3", ["ab"]), ("n4", ["", "č"]), ("n5", [])]
    index = match.anchor_index(spark.createDataFrame(needles, "id string, parts array<string>"), needle_id="id", parts="parts").collect()
    found = {r.id: r for r in index}
    assert set(found) == {"n1", "n2", "n3", "n4"}
    for name, parts in needles[:4]:
        r = found[name]
        usable = [p for p in parts if p]
        assert usable[r._part][r._offset :].startswith(r._gram) and len(r._gram) == r._size
    counts = Counter(g for _, parts in needles[:2] for p in parts for g in {p[i : i + 8] for i in range(len(p) - 7)})
    assert counts[found["n1"]._gram] == counts[found["n2"]._gram] == 1
    assert (found["n3"]._size, found["n4"]._size) == (2, 1)


def test_substring_join_reads_the_texts_once(spark):
    rnd = random.Random(8)
    texts = [(i, "".join(rnd.choice("abcč ") for _ in range(rnd.randrange(200))), i % 5) for i in range(300)]
    needles = [(i, ["".join(rnd.choice("abcč ") for _ in range(rnd.choice([1, 2, 3, 5, 8, 12])))]) for i in range(60)]
    t = spark.createDataFrame(texts, "tid long, text string, extra long")
    n = spark.createDataFrame(needles, "nid long, parts array<string>")
    derive = lambda text, parts: [F.instr(text, parts[0]).alias("at")]
    joined = match.substring_join(t, n, text_id="tid", text="text", needle_id="nid", parts="parts", carry=["extra"], derive=derive)
    got = {(r.tid, r.nid, r.extra, r.at) for r in joined.collect()}
    assert got == {(i, j, e, s.index(p[0]) + 1) for i, s, e in texts for j, p in needles if p[0] and p[0] in s}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [tid") + plan.count("LocalRelation [tid") <= 1
