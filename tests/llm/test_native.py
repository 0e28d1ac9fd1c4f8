"""URL filter, quality rules, line dedup and decontamination."""

from __future__ import annotations

import itertools
import math
import random
import re

from pyspark.sql import functions as F

from pricewren.llm import decontaminate, line_dedup, quality_rules, url_filter
from pricewren.llm.queries import URL_FALLBACK, URL_RULES
from pricewren.llm.url_filter import Rule

from . import brute

DOCS = "doc_id long, text string, source string"


def urls(spark, values, rules, fallback=()):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(values)], "page_id long, url string, host string, rule string")
    found = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules, list(fallback)), ["page_id"])
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}


def test_url_rules_and_ties(spark):
    values = [
        "http://net/", "http://a.net", "https://A.Example.NET/en/x?q", "http://example.com/de/", "http://notexample.com/de/", "ftp://w.org/fr/1",
        "http://internet/", None, "", "no scheme", "http://x.net/login/", "http://x.org/login/a", "http://a.net/", "http://a.net/", "x://b.NET/a\nb",
    ]
    got = urls(spark, values, URL_RULES, URL_FALLBACK)
    assert len(got) == len(values)
    assert got[0] == ("net", "/", "net/", "block")
    assert got[1] == ("a.net", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2:] == ("net/", "block") and got[11][2:] == (None, "block")
    assert got[12] == got[13] == ("a.net", "/", "net/", "block")
    assert got[14] == ("b.net", "/a\nb", "net/", "block")


def test_url_rule_without_token_and_block_wins(spark):
    got = urls(spark, ["http://a.b/c*d", "http://a.b/x"], [Rule("allow", "a.b"), Rule("block", "a.b")], [Rule("block", pattern="*")])
    assert got[0][2:] == ("a.b", "block") and got[1][2:] == ("a.b", "block")
    got = urls(spark, ["http://q.b/c"], [], [Rule("block", pattern="*")])
    assert got[0][2:] == (None, "block")
    assert urls(spark, [], URL_RULES) == {}


def test_rules_are_filed_under_their_rarest_token(spark):
    seen = spark.createDataFrame([(f"http://a{i}.example.com/de/",) for i in range(9)] + [("http://b.example.net/",)], "url string")
    rules = url_filter.rule_table(spark, [Rule("block", "example.net", "/de/"), Rule("block", pattern="*")], [])
    filed = {r.rule: r.token for r in url_filter.index_rules(rules, seen).collect()}
    assert filed == {"example.net/de/": "net", "*": ""}


def test_quality_measures_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a b c d e f g h " * 3, "x " * 40, "same\nsame\n\n same\n", "# * $ <a> &"]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 80))) + "\n" * rnd.randrange(3) for _ in range(150)]
    texts += ["w" * 100_000, " ".join(map(str, range(30_000))), "p q r s t u v w x " * 5_000]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], DOCS).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute.quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, (t or "")[:80])
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_host_verdicts_are_shrunk_and_joined_back(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "too short"
    rows = [(i, good, "good") for i in range(60)] + [(100 + i, bad, "bad") for i in range(60)] + [(200, good, "bad"), (300, good, "tiny"), (301, good, None), (301, good, None)]
    rows += [(400 + i, good, f"other{i % 7}") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    assert got[0].kept and got[300].kept and got[301].kept and not got[100].kept
    assert got[200].host_verdict == "reject" and not got[200].kept and not got[200].base_failed
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _ in rows if got[i].kept)
    empty = docs.where("false")
    assert quality_rules.keep(empty).count() == 0 and quality_rules.judge(empty, ["doc_id"]).count() == 0


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(8)
    pool = [f"Line number {k} of the pool" for k in range(12)] + ["short", "", "  ", "LINE NUMBER 3 of the pool ", "\tÄrger und ärger zwei", "ärger und ärger zwei"]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 12)))) for i in range(80)] + [(90, None), (91, "")]
    docs += [(95, "\n".join(f"unique {k} line" if k % 2 else "Line number 1 of the pool" for k in range(20_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_lines": F.lit(1), "at": F.lit("clash"), "id": F.lit(2)})
    out = line_dedup.dedup_lines(df.drop("n_lines"))
    got, want = {r.doc_id: r for r in out.collect()}, brute.dedup_lines(docs)
    assert {i: (r.text, r.n_dropped) for i, r in got.items()} == want
    assert got[90].n_lines == 1 and got[90].text == "" and got[5].at == "clash" and got[5].id == 2


def test_line_dedup_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a common line here"), (1, "a common line here"), (1, "other text of the id\na common line here"), (None, "a common line here"), (2, "A COMMON LINE HERE \nmine")]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([*rows[:4], (2, "mine")], key=str)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    three = line_dedup.dedup_lines(spark.createDataFrame([(i, "a common line here") for i in (1, 2)], "doc_id long, text string"), min_documents=3)
    assert {r.n_dropped for r in three.collect()} == {0}


def test_overlaps_tolerate_substitutions(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [(k, [word() for _ in range(30)]) for k in range(5)] + [(7, ["tiny", "item", "here"])]
    fill = lambda n: [word() for _ in range(n)]
    swapped = list(items[1][1])
    for at in (4, 11, 19, 26):
        swapped[at] = "other"
    docs = [
        (0, fill(50) + items[0][1] + fill(50)), (1, fill(9) + swapped), (2, items[2][1][:15] + fill(20)), (3, items[3][1][:9] + fill(60)), (4, fill(300)),
        (5, fill(3) + ["Tiny,", "ITEM", "here!"] + fill(3)), (6, []), (8, items[0][1] + fill(4) + items[4][1]), (8, items[0][1]),
    ]
    rows = [(i, " ".join(w), "x") for i, w in docs] + [(9, None, "x"), (None, " ".join(items[0][1]), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(50, None), (51, ""), (60, " ".join(items[0][1]))], "item_id long, text string")
    want = {(0, 0), (1, 1), (2, 2), (5, 7), (8, 0), (8, 4), (None, 0)}
    for limit in (decontaminate.MAX_BROADCAST, 0):  # both ways of the join
        found = decontaminate.overlaps(df, bench, max_broadcast=limit)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    kept = decontaminate.remove_contaminated(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 9] and kept.columns == df.columns
    assert decontaminate.overlaps(df, bench.where("false")).count() == 0
    assert decontaminate.overlaps(df.where("false"), bench).count() == 0


def test_overlaps_find_every_pattern_that_meets_the_bar(spark):
    """op4_decontaminate: all places of the unequal words, for items shorter than, as long as and longer than a stretch."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (*range(5, 14), 15)}
    docs, want = [], set()
    for n, words in items.items():
        need = min(n, 13)
        for swapped in itertools.combinations(range(n), 3 if n == 15 else n - math.ceil(0.8 * n - 1e-9)):
            text = [f"x{k}" if k in swapped else w for k, w in enumerate(words)]
            if max(sum(i + k not in swapped for k in range(need)) for i in range(n - need + 1)) >= 0.8 * need:
                want.add((len(docs), n))
            docs.append((len(docs), " ".join(["before", "it", *text, "after", "it"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()} == want


def test_contaminated_rows_without_id_are_kept_apart(spark):
    item = " ".join(f"word{k}" for k in range(20))
    df = spark.createDataFrame([(None, item), (None, "a clean text"), (None, None), (1, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r.text or "" for r in decontaminate.remove_contaminated(df, bench).collect()) == ["", "a clean text", "clean"]


def test_hits_hold_only_the_words_around_them(spark):
    """op4_decontaminate: what is compared outside the compiled loop, where a document's hits are held, has no document's words."""
    passage = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"{passage} " * 30), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"{passage} x{k} y{k}") for k in range(6)], "item_id long, text string")
    found = decontaminate.overlaps(df, bench)
    compared = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "array_max(" in line]
    assert len(compared) == 1 and not re.search(r"\bwords#", compared[0])
    want = sorted(map(tuple, found.collect()))
    assert want == [(1, k, 22, 13) for k in range(6)]
    # A benchmark beyond the bound takes several passes, none of which shuffles a text.
    parts = decontaminate.overlaps(df, bench, max_broadcast=100)
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 8
    assert sorted(map(tuple, parts.collect())) == want
