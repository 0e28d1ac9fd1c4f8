"""Near-duplicate groups against brute force, sketches, components, and the pipeline."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from pricewren.llm import near_dup
from pyspark.sql import functions as F

from . import brute


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(pool)
    pool = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    docs, i = [], 0
    for size in (3, 5, 6, 9, 20, 60, 300):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for k in range(rnd.randrange(1, 8)):
                copy = list(base)
                for _ in range(rnd.randrange(0, 1 + max(1, size // 15))):
                    copy[rnd.randrange(len(copy))] = word()
                if k % 3 == 2:
                    copy = [w.upper() for w in copy]
                docs.append((i, "  ".join(copy)))
                i += 7
    chain = [word() for _ in range(200)]
    for k in range(30):  # neighbours are close, ends are far apart
        docs.append((i, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
        i += 1
    rnd.shuffle(docs)
    return docs + [(100_000, None), (100_001, ""), (100_002, " \n"), (100_003, "one"), (100_004, "ONE"), (100_005, "one two")]


def test_groups_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("clash"), "key": F.lit(1), "registers": F.lit(2)})
    for size in (2, 5):
        want = brute.near_dup(docs, size, 80)
        got = {r.id: (r.n_shingles, r.component_id) for r in near_dup.group(df, size=size).collect()}
        assert got == want
    kept = near_dup.keep_one(df, size=5)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_large_group_of_copies_and_near_copies(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    docs = []
    for i in range(400):
        copy = list(base)
        if i % 2:
            for _ in range(6):
                copy[rnd.randrange(120)] = f"x{rnd.randrange(9999)}"
        docs.append((i, " ".join(copy)))
    got = {r.id: r.component_id for r in near_dup.group(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()}
    assert got == {i: c for i, (_, c) in brute.near_dup(docs, 2, 80).items()}


def test_repeated_rows_missing_ids_and_empty_table(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (2, "q r s t u v"), (4, "q r s t u v"), (None, "a b c d e f"), (9, "A B c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.component_id, r.kept) for r in near_dup.group(df, size=2).collect()), key=str)
    assert got == sorted([(4, 2, False), (4, 2, False), (2, 2, True), (4, 2, False), (None, None, True), (9, 2, False)], key=str)
    assert near_dup.group(df.where("false"), size=2).count() == 0
    # An id that is the smallest of none of its classes ties them as well.
    tied = [(5, "a b c d"), (3, "a b c d"), (5, "q r s t"), (4, "q r s t")]
    found = near_dup.group(spark.createDataFrame(tied, "doc_id long, text string"), size=2).collect()
    assert {r.component_id for r in found} == {3}


def test_sketch_estimates():
    rnd = np.random.default_rng(1)
    shared, a, b = (rnd.integers(0, 1 << 64, n, np.uint64) for n in (4000, 500, 500))
    left, right = near_dup.sketch(np.unique(np.concatenate([shared, a]))), near_dup.sketch(np.unique(np.concatenate([shared, b])))
    similarity, n = near_dup.estimate(left, right)
    assert n == near_dup.REGISTERS and abs(similarity - 0.8) < 0.11
    other = near_dup.sketch(rnd.integers(0, 1 << 64, 4000, np.uint64))
    assert near_dup.estimate(left, other)[0] < 0.03
    assert len(near_dup.band_keys(near_dup.sketch(np.array([5], np.uint64)))) == near_dup.BANDS
    assert len(near_dup.band_keys(near_dup.sketch(np.empty(0, np.uint64)))) == 0


def test_components_of_a_long_path(spark):
    ids = list(range(1, 60))
    random.Random(1).shuffle(ids)
    edges = [*zip(ids, ids[1:], strict=False), (100, 101), (102, 101), (5, 5)]
    got = {r.id: r.label for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 60)}, 101: 100, 102: 100}


def test_pipeline_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dup", "decontaminate", "byte_bpe"]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = near_dup.staged(stage(spark, docs, sf_dir))
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == out.count()
        pairs = [(r.doc_id, r.text) for r in rows]
        if name == "quality_rules":
            failed = {i for i, t in pairs for q in [brute.quality(t)] if q[0] < 20 or 100 * q[4] > 30 * q[0]}
            assert set(got) == {i for i, _ in pairs} - failed
        elif name == "line_dedup":
            assert {i: r.text for i, r in got.items()} == {i: x[0] for i, x in brute.dedup_lines(pairs).items()}
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_dup":
            assert set(got) == {i for i, (_, c) in brute.near_dup(pairs, 5, 80).items() if i == c}
        elif name == "decontaminate":
            assert set(got) == {i for i, t in pairs if not any(b in t for b in bench)}
        else:
            assert {i: r.text for i, r in got.items()} == dict(pairs) and all(r.n_tokens == len(r.token_ids) for r in got.values())
        if name != "byte_bpe":
            assert out.columns == docs.columns
        docs = out
    final = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in final.collect()} == set(got)
