"""Collocations, substring removal and hard negatives against plain definitions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewren.llm import collocations, hard_negatives, substring_dedup

from . import brute


def _collocations(docs, longest, least, top):
    counts = {}
    for lang, text in docs:
        found = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.TO_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    found[tuple(words[i : i + m])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        candidates = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        rows = []
        for k, a in candidates.items():
            score, _, left, right = min((1_000_000 * a * a // (c[k[:j]] * c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
            inside = (b for q, b in candidates.items() if len(q) > len(k) and any(q[i : i + len(k)] == k for i in range(len(q))))
            if not any(100 * b >= 50 * a for b in inside):
                rows.append((score, a, " ".join(k), left, right))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n, s) for i, (s, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "top", "share", "seen"), [(3, 10, 2000, 16, 2), (3, 10, 7, 4, 1), (5, 6, 2000, 50, 1), (2, 10, 2000, 16, 2)])
def test_collocations_against_counting(spark, monkeypatch, longest, least, top, share, seen):
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    rnd = random.Random(3)
    words = ["the", "A", "b", "New", "york", "city", "é", "x\x85y", "z", "of", "q", "\x00w"] + [f"r{i}" for i in range(40)]

    def text():
        out = []
        for _ in range(rnd.randrange(60)):
            out.append(rnd.choice(words) if rnd.random() < 0.7 else rnd.choice(["new york city", "the city of", "New York", "a b a b a b"]))
            out.append(rnd.choice(["  ", "\t", ". ", ",", "\n", "\x0b"]) if rnd.random() < 0.4 else " ")
        return "".join(out)

    docs = [(rnd.choice(["en", "de", None, "und"]), text()) for _ in range(300)] + [("en", None), ("fr", ""), ("fr", "...,")]
    docs += [("en", "alpha beta gamma delta")] * 60 + [("en", "so long " * 20_000)]
    df = spark.createDataFrame([(k, t, 1, 2, "w") for k, t in docs], "lang string, text string, n int, phrase int, h string")
    got = collocations.mine(df, max_words=longest, min_count=least, top_k=top, share=share, sample_count=seen)
    assert sorted(map(tuple, got.collect())) == _collocations(docs, longest, least, top)


def test_collocations_of_nothing_and_of_many_languages(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).count() == 0
    docs = [(f"l{k % 150}", "one two one two one two") for k in range(1500)]
    got = collocations.mine(spark.createDataFrame(docs, "lang string, text string")).collect()
    assert sorted(map(tuple, got)) == _collocations(docs, 3, 10, 2000)


def test_admitted_phrases_hold_all_that_was_put_in(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 3000)
    df = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    table = collocations.Admitted.of(df, 16)
    assert table.has(hashes).all()
    assert table.has(np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 3000)).mean() < 0.05
    assert not collocations.Admitted.of(df.where("false"), 16).has(hashes).any()


def _without_repeats(docs, window):
    first = {}
    for i, text in docs:
        words = (text or "").encode().split()
        for s in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        words, gone = (text or "").encode().split(), set()
        for s in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "vocabulary"), [(50, 5000), (50, 3), (8, 4), (100, 3)])
def test_repeats_against_all_windows(spark, window, vocabulary):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randrange(300))] for _ in range(40)]
    docs = [(None, " ".join(base[3])), (5, None), (6, ""), (7, "a " * 400), (8, "a\n" * 300), (9, "b " * 120 + "a " * 200)]
    for i in range(10, 150):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(4) if words else 0):
            words[rnd.randrange(len(words))] = "x"
        words += rnd.choice(base) if rnd.random() < 0.5 else []
        docs.append((i if rnd.random() < 0.9 else 60, " ".join(words)))
    docs += [docs[-1]] * 30 + [(3, "long " * 100_000)]
    rows = [(i, t, 1, "x", 5, 6) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, id string, a int, mask int")
    got = substring_dedup.remove_repeats(df, window)
    assert got.columns == ["doc_id", "text", "id", "a", "mask", "n_words", "n_removed"]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()], key=str) == _without_repeats(docs, window)
    assert substring_dedup.remove_repeats(df.where("false"), window).count() == 0


def test_minimizers_are_the_leftmost_least():
    rnd = np.random.default_rng(4)
    for size in (1, 2, 3, 5, 8, 35):
        values = rnd.integers(0, 6, 200).astype(np.uint64)
        want = [i + int(np.argmin(values[i : i + size])) for i in range(200 - size + 1)]
        assert substring_dedup.least(values, size).tolist() == want


def _negatives(rows, every):
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        if i not in known or (label, v) < known[i]:
            known[i] = (label, v)
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a in sorted(known):
        if a % every:
            continue
        label, v = known[a]
        scores = sorted((-clip(sum(x * y for x, y in zip(v, known[b][1]))), b) for b in known if b != a)
        for s, b in [(s, b) for s, b in scores if known[b][0] == label][:5]:
            fit = [(t, c) for t, c in scores if known[c][0] != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, b, k + 1, c, -s, -t) for k, (t, c) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("n", "width", "slab_bytes"), [(300, 8, 16_000_000), (300, 8, 1500), (400, 3, 16_000_000)])
def test_hard_negatives_against_all_scores(spark, n, width, slab_bytes):
    rnd = random.Random(2)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in centres[i % 6]], rnd.randrange(3)) for i in range(n)]
    rows += [(2000 + i, [1.0] * width, i % 2) for i in range(200)]  # one vector, many times
    rows += [(1000, None, 1), (1001, [1.0, None] + [0.0] * (width - 2), 1), (1002, [math.nan] * width, 0), (1003, [math.inf] * width, 0)]
    rows += [(None, [1.0] * width, 1), (1004, [1.0] * width, None), (1005, [], 1), (1006, [1e30] * width, 2), (1010, [0.0] * width, 1)]
    rows += [(10, [5.0] * width, 0), rows[3], rows[20], (1020, [1.0], 0), (1030, [-1.0] * width, 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, vector string")
    got = hard_negatives.mine(df, F.col("id") % 10 == 0, slab_bytes=slab_bytes)
    assert sorted(map(tuple, got.collect())) == _negatives(rows, 10)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (200, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(alone, F.col("id") % 100 == 0).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(7)
    for width in (2, 8, 64):
        a, b = rng.integers(-300, 300, (60, width)).astype(float), rng.integers(-300, 300, (80, width)).astype(float)
        a[0], b[0], b[1] = 0, a[1], -3 * a[2]
        references = hard_negatives._unit(rng.normal(size=(12, width)))
        references[0] = hard_negatives._unit(a[1:2])[0]
        low, high = hard_negatives.score_bounds(
            hard_negatives.angles(a, references), hard_negatives._norms(a), hard_negatives.angles(b, references), hard_negatives._norms(b)
        )
        assert ((low <= a @ b.T) & (a @ b.T <= high)).all()
