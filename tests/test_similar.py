"""Groups of similar names and dictionary blocks against plain definitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pricewren.operators import extract, similar


def _groups(rows, percent):
    sets = {i: (k, frozenset((n or "").split())) for i, k, n in rows}
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            (ka, s), (kb, t) = sets[a], sets[b]
            if ka == kb and s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) if sets[i][1] else None for i in ids}


@pytest.mark.parametrize(("percent", "words", "longest"), [(60, 30, 9), (80, 12, 14)])
def test_similar_groups_against_all_pairs(spark, percent, words, longest):
    rnd = random.Random(1)
    name = lambda: " ".join(f"t{int(rnd.random() ** 2 * words)}" for _ in range(rnd.randrange(longest)))
    rows = [(i, rnd.choice(["a", "b", None]), name() if rnd.random() < 0.97 else None) for i in range(400)]
    rows += [(1000 + i, "a", f"hot u{i} v{i}") for i in range(60)] + [(2000 + i, "a", "same name") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, page string, name string")
    got = similar.similar_groups(df, ["page"], id_col="id", tokens=F.split("name", " "), percent=percent)
    assert got.columns == ["id", "page", "name", "groupId"]
    assert {r.id: r.groupId for r in got.collect()} == _groups(rows, percent)
    assert similar.similar_groups(df.where("false"), ["page"], id_col="id", tokens=F.split("name", " ")).count() == 0


def test_sizes_and_shared_tokens():
    for percent in (34, 50, 60, 80, 100):
        for p in range(1, 20):
            for q in range(1, 20):
                least = next(c for c in range(1, p + q + 1) if 100 * c >= percent * (p + q - c))
                assert similar.need(p, q, percent) == least
                assert (q in similar.partner_sizes(p, percent)) == (least <= min(p, q))


def test_connected_follows_long_paths(spark):
    links = [(i, i + 1) for i in range(300) if i != 150] + [(0, k) for k in range(400, 600)]
    found = {r.id: r.component for r in similar.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 if i <= 150 or i >= 400 else 151 for i in [*range(301), *range(400, 600)]}


def test_dictionary_of_any_size(spark):
    rnd = random.Random(2)
    starts = sorted({"".join(rnd.choice("abč ") for _ in range(rnd.choice([1, 2, 3, 5, 9, 12]))) for _ in range(60)} | {"a😀b", "Káva", "káva alfa"})
    texts = [None, "", "xyz", "x KÁVA ALFA y káva z 😀😀 A😀B abc"] + ["".join(rnd.choice("ABČabč x😀") for _ in range(rnd.randrange(120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    fold = lambda s: s.lower().replace("č", "c").replace("á", "a")
    want = set()
    for i, text in enumerate(texts):
        found = []
        for at in range(len(text or "")):
            hits = [s for s in starts if fold(s) and fold(text)[at:].startswith(fold(s))]
            if hits:
                found.append((at, min((-len(fold(s)), s) for s in hits)[1]))
        for (at, start), end in zip(found, [*[f[0] for f in found[1:]], len(text or "")], strict=True) if found else ():
            want.add((i, at, start, " ".join(text[at:end].split())))
    for given in (spark.createDataFrame([(s,) for s in starts], "start string"), starts):
        got = {tuple(r) for r in extract.extract_dictionary_blocks(df, given).collect()}
        assert got == want
    assert extract.extract_dictionary_blocks(df, []).count() == 0
