"""Groups of similar names (row A14 at scale): a set-similarity join without pairs, and connected groups.

Two token sets of sizes p and q have a Jaccard similarity of at least t exactly if they
share ``need(p, q) = ceil(t * (p + q) / (1 + t))`` tokens.  So both hold one common subset
of that many tokens.  Short names (up to MAX_SUBSET tokens) are filed under all such
subsets: all members of sizes p and q in the file of (subset, p, q) are similar to each
other, without any verification, and link to the file's smallest id.  That is linear in
the number of names, also where a third of them are alike.

Pairs with a longer name go by prefix filter: tokens are ordered from rare to frequent; two
similar sets share a token among the first ``size - ceil(t * size) + 1`` of either.  These
candidates are verified by their token sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from pricewren.session import staged

#: Longest name, in tokens, that is filed under subsets.
MAX_SUBSET = 8


def need(p: int, q: int, percent: int) -> int:
    """Tokens that sets of p and q tokens must share for a similarity of ``percent`` %."""
    return -(-percent * (p + q) // (100 + percent))


def partner_sizes(p: int, percent: int) -> range:
    """Sizes that can reach the similarity with a set of p tokens."""
    return range(ceil(p * percent / 100), p * 100 // percent + 1)


def _codes(size: int, percent: int) -> list[int]:
    """The subset files of a set of ``size`` tokens: a bit per token, then p and q (p <= q) in 8 bits each."""
    codes = []
    for other in partner_sizes(size, percent):
        if other <= MAX_SUBSET:
            for places in combinations(range(size), need(size, other, percent)):
                codes.append(sum(1 << i for i in places) | min(size, other) << 16 | max(size, other) << 24)
    return codes


def _files(percent: int) -> Column:
    """The subset files of a name's sorted ``_tokens``: struct(subset, p, q)."""
    codes = F.lit([]).cast("array<int>")
    for size in range(1, MAX_SUBSET + 1):
        codes = F.when(F.size("_tokens") == size, F.lit(_codes(size, percent)).cast("array<int>")).otherwise(codes)
    byte = lambda c, at: F.shiftright(c, at).bitwiseAND(F.lit(255))
    return F.transform(codes, lambda c: F.struct(
        F.filter("_tokens", lambda _, i: F.call_function("shiftright", c, i).bitwiseAND(F.lit(1)) == 1).alias("subset"),
        byte(c, 16).alias("p"), byte(c, 24).alias("q"),
    ))


def similar_links(names: DataFrame, keys: Sequence[str], percent: int) -> DataFrame:
    """``(a, b)`` with a < b: links that connect all names of a key whose similarity is ``percent`` % or more.

    ``names``: the keys, ``_id`` and ``_tokens``, a sorted array of distinct tokens; one row per distinct set and key.
    """
    keys = list(keys)
    size = F.size("_tokens")
    filed = names.filter(size <= MAX_SUBSET).select(*keys, "_id", size.alias("_size"), F.explode(_files(percent)).alias("_f"))
    flat = filed.select(*keys, "_id", "_size", "_f.subset", "_f.p", "_f.q")
    files = flat.groupBy(*keys, "subset", "p", "q").agg(F.min("_id").alias("a"), F.max("_id").alias("z"), F.min("_size").alias("least"), F.max("_size").alias("most"))
    # A file of two sizes connects its members only if it has members of both.
    linking = staged(files.filter("a < z AND least = p AND most = q").select(*keys, "subset", "p", "q", "a"), "files")
    short = flat.join(linking, [*keys, "subset", "p", "q"]).filter("_id > a").select("a", F.col("_id").alias("b"))

    numbers = names.select(F.explode("_tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = names.select(*keys, "_id", size.alias("size"), F.explode("_tokens").alias("token")).join(numbers, "token").groupBy(*keys, "_id", "size").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("_tokens")
    )
    share = F.lit(percent) * F.col("size")
    first = F.col("size") - F.ceil(share / 100) + 1
    prefixed = ranked.withColumn("_prefix", F.slice("_tokens", F.lit(1), first.cast("int")))
    long = prefixed.filter(F.col("size") > MAX_SUBSET)
    probes = long.select(*keys, F.col("_id").alias("x"), F.col("size").alias("sx"), F.col("_tokens").alias("tx"), F.explode("_prefix").alias("token"))
    others = prefixed.select(*keys, F.col("_id").alias("y"), F.col("size").alias("sy"), F.col("_tokens").alias("ty"), F.explode("_prefix").alias("token"))
    fits = (F.col("sy") * 100 >= F.col("sx") * percent) & (F.col("sx") * 100 >= F.col("sy") * percent)
    pairs = probes.join(others, [*keys, "token"]).filter(fits & ((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & (F.col("sy") <= MAX_SUBSET))))
    both = F.size(F.array_intersect("tx", "ty"))
    similar = both * 100 >= percent * (F.col("sx") + F.col("sy") - both)
    longer = pairs.filter(similar).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return short.unionByName(longer).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``(id, component)`` of all linked ids: the smallest id that links lead to.

    Large and small stars in turn: every id hands its neighbours the smallest one it
    knows, until nothing changes.  Rounds grow with the logarithm of the longest path;
    each is written to the shared folder, and two numbers come back from it.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            ).groupBy("id").agg(F.min("component").alias("component"))
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = staged(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
        )))
        edges = staged(small.filter("u <> v").distinct(), "edges")


def similar_groups(rows: DataFrame, keys: Sequence[str], *, id_col: str, tokens: Column, percent: int = 60) -> DataFrame:
    """Rows with ``groupId``, the smallest id whose name is connected to theirs by similarities of ``percent`` % within the key.

    Equal token sets are one name.  Rows without tokens (null or empty) get a null group;
    a name similar to none is a group of its own.  Null keys are a key.  Ids must be unique.
    """
    keys = list(keys)
    named = rows.withColumn("_tokens", F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull() & (t != "")))))
    safe = [F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")).alias("_key")]
    sets = staged(named.filter(F.size("_tokens") > 0).select(*safe, "_tokens", id_col).groupBy("_key", "_tokens").agg(F.min(id_col).alias("_id")), "sets")
    groups = connected(similar_links(sets, ["_key"], percent))
    found = sets.join(groups, sets["_id"] == groups["id"], "left").select(
        F.col("_key").alias("_of"), F.col("_tokens").alias("_set"), F.coalesce("component", "_id").alias("groupId")
    )
    joined = named.withColumn("_key", safe[0]).join(staged(found, "groups"), (F.col("_key") == F.col("_of")) & (F.col("_tokens") == F.col("_set")), "left")
    return joined.select(*rows.columns, "groupId")
