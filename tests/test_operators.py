import pytest
from pyspark.sql import functions as F

from pricewren.functions.text import normalize_loose
from pricewren.operators import dedupe, enrich, lines, match
from pricewren.plans import audit, combine, serve


@pytest.fixture(scope="module")
def offers(spark):
    rows = []
    for i in range(300):
        # One product holds a third of all rows.
        name = "Pivo Alfa" if i % 3 == 0 else f"Zboží {i % 17}"
        rows.append((f"id{i:03d}", f"s{i % 4}", "Chain A" if i % 2 else "Chain B", f"Store {i % 4}", name, "500 g",
                     float(10 + (i * 7) % 50), float(1 + (i * 5) % 23), ["high", "medium", "low", "?"][i % 4], i % 11 == 0, i % 5 + 1))
    return spark.createDataFrame(
        rows,
        "id string, storeId string, chain string, storeName string, product string, packageSize string, price double, "
        "unitPrice double, confidence string, suspect boolean, pageNumber int",
    ).cache()


def test_dedupe_is_idempotent_and_keeps_last(offers):
    key = ["storeId", "product"]
    once = dedupe.dedupe_last(offers, ["id"], key)
    twice = dedupe.dedupe_last(once, ["id"], key)
    assert sorted(once.collect()) == sorted(twice.collect())
    want = {}
    for r in sorted(offers.collect(), key=lambda r: r["id"]):
        want[(r["storeId"], r["product"])] = r["id"]
    assert {(r["storeId"], r["product"]): r["id"] for r in once.collect()} == want


def test_append_new_is_disjoint_from_base(offers):
    base, batch = offers.filter("pageNumber = 1"), offers.filter("pageNumber <> 1")
    added = dedupe.new_offers(base, batch, ["id"])
    names = lambda df: {r["n"] for r in df.select(normalize_loose("product").alias("n")).collect()}
    assert not names(added) & names(base)
    assert names(added) | names(base) == names(offers)
    assert added.count() == len(names(added))
    report = dedupe.append_report(base, batch, ["id"]).first()
    assert report["output"] == base.count() + added.count() and report["added"] + report["skipped"] == batch.count()


def test_modes_and_cheapest(offers):
    everything = {r["id"] for r in serve.filter_quality(offers, "all").collect()}
    for mode in ("high", "review", "trusted"):
        assert {r["id"] for r in serve.filter_quality(offers, mode).collect()} <= everything
    assert everything == {r["id"] for r in offers.collect()}
    best = {r["key"]: r["value"] for r in serve.cheapest_by_key(offers).collect()}
    values = offers.groupBy(serve.comparable_key(offers).alias("k")).agg(F.min("unitPrice").alias("v")).collect()
    assert best == {r["k"]: r["v"] for r in values}
    flagged = serve.flag_cheapest(offers).filter("isCheapest").count()
    assert flagged == len(best)


def test_cheapest_is_decided_before_the_text_query(spark):
    rows = [("a", "s", "Mléko", "levné", 10.0), ("b", "s", "Mléko", "drahé", 20.0)]
    df = spark.createDataFrame(rows, "id string, storeId string, product string, description string, price double").withColumns(
        {"unitPrice": F.col("price"), "confidence": F.lit("high"), "suspect": F.lit(False)}
    )
    assert serve.cheapest_visible(df, text="drahé").count() == 0
    assert [r["id"] for r in serve.cheapest_visible(df, text="levne").collect()] == ["a"]


def test_zero_unit_price_counts_as_missing(spark):
    df = spark.createDataFrame([("a", "X", 0.0, 5.0), ("b", "X", 3.0, 9.0), ("c", "X", None, None)], "id string, product string, unitPrice double, price double")
    assert [(r["id"], r["value"]) for r in serve.cheapest_by_key(df).collect()] == [("b", 3.0)]


def test_merge_prefers_article_numbers(spark):
    rows = [(1, "Máslo", 10.0, "u?1", "", "mléčné"), (2, "máslo", 10.0, "u?2", "77", ""), (3, "Máslo", 10.0, "u", "88", "x"), (4, "Sýr", 1.0, "", "", "c")]
    df = spark.createDataFrame(rows, "seq int, product string, price double, imageUrl string, klNr string, category string")
    got = {(r["seq"], r["klNr"], r["category"]) for r in dedupe.merge_prefer_key(df, ["seq"]).collect()}
    assert got == {(2, "77", "mléčné"), (4, "", "c")}


def test_substring_join_equals_brute_force(spark):
    texts = [(i, t) for i, t in enumerate(["the cat sat", "a b", "xyz", "catalog of cats", "", "the the the"] + ["hot text the"] * 60)]
    needles = [(1, ["cat"]), (2, ["the", "sat"]), (3, ["a"]), (4, ["zz"]), (5, [""]), (6, ["cat", ""]), (7, ["e c"]), (8, ["b", "a"]), (9, ["hot text the"])]
    t = spark.createDataFrame(texts, "tid int, text string")
    n = spark.createDataFrame(needles, "nid int, parts array<string>")
    got = {(r["tid"], r["nid"]) for r in match.substring_join(t, n, text_id="tid", text="text", needle_id="nid", parts="parts").collect()}
    want = {(i, j) for i, s in texts for j, ps in needles if any(ps) and all(p in s for p in ps if p)}
    assert got == want


def test_substring_join_on_pages(spark):
    t = spark.createDataFrame([(1, 1, "alfa beta"), (2, 2, "alfa beta")], "tid int, page int, text string")
    n = spark.createDataFrame([("n", 1, ["beta"])], "nid string, page int, parts array<string>")
    got = match.substring_join(t, n, text_id="tid", text="text", needle_id="nid", parts="parts", on=["page"]).collect()
    assert [(r["tid"], r["nid"]) for r in got] == [(1, "n")]


def test_validity_fallback(spark):
    index = spark.createDataFrame([(0, "", "", ""), (1, "5", "2026-05-13", "2026-05-19"), (2, "5", "2026-05-20", "2026-05-26")], "seq int, klNr string, dateFrom string, dateTo string")
    offers = spark.createDataFrame([("a", "5"), ("b", ""), ("c", "9")], "id string, klNr string")
    got = {r["id"]: r["validFrom"] for r in match.attach_validity(offers, index, "seq").collect()}
    assert got == {"a": "2026-05-20", "b": "2026-05-13", "c": "2026-05-13"}


def test_combine(spark):
    one = spark.createDataFrame([("Pivo  Braník", "0,5 l", "12.9", "2", 0), ("VEZMĚTE SI nyní", "", "5", None, 1), ("bez ceny", "", None, None, 2)],
                                "product string, packageSize string, price string, pageNumber string, seq long")
    two = spark.createDataFrame([("Pivo Braník", "0,5 l", 12.9, "true", 0), ("Máslo", "250 g", 49.9, None, 1)], "product string, packageSize string, price double, suspect string, seq long")
    got = combine.combine_offers({"feed one": one, "feed two": two}, sort=True).collect()
    assert [(r["product"], r["chain"], r["unit"], r["confidence"]) for r in got] == [
        ("Pivo Braník", "feed one", "Kč/ks", "high"), ("Máslo", "feed two", "Kč/ks", "high")]
    beer = got[0]
    assert beer["category"] == "pivo" and "pivo" in beer["searchTerms"] and beer["compareKey"] == "branik 0 5 l" and beer["pageNumber"] == 2
    assert beer["description"] == "pivo" and beer["id"] == "feed one-Pivo  Braník-12.9"


def test_czech_collation(spark):
    df = spark.createDataFrame([("Chléb",), ("Cibule",), ("Hrách",), ("Čočka",)], "product string").withColumn("pageNumber", F.lit(1))
    assert [r["product"] for r in lines.sort_by_page(df).collect()] == ["Cibule", "Čočka", "Hrách", "Chléb"]


def test_ranges_and_aliases(spark):
    ranges = spark.createDataFrame([(1, 3, "a"), (3, 4, "b")], "from int, to int, category string")
    pages = spark.createDataFrame([(i,) for i in range(1, 6)], "pageNumber int")
    got = {r["pageNumber"]: r["rangeCategory"] for r in enrich.category_by_ranges(pages, ranges).collect()}
    assert got == {1: "a", 2: "a", 3: "a", 4: "b", 5: None}
    aliases = spark.createDataFrame([("old", "new")], "alias string, id string")
    stores = spark.createDataFrame([("old",), ("x",), (None,)], "storeId string")
    assert sorted(str(r["storeId"]) for r in enrich.canonical_store_id(stores, aliases).collect()) == ["None", "new", "x"]


def test_hot_group_is_limited_before_the_shuffle(offers):
    plan = dedupe.dedupe_last(offers, ["id"], ["product"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    plan = serve.cheapest_by_key(offers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_no_cartesian_products(offers, spark):
    expected = spark.createDataFrame([(1, "pivo alfa"), (2, "zboží 3")], "tid int, term string")
    texts = offers.select("id", F.lower("product").alias("text"))
    df = match.match_expected(texts, expected, text_id="id", text="text", term_id="tid", term="term")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_duplicates(offers):
    groups = {(r["page"], r["name"], r["price"]): r["count"] for r in audit.exact_duplicate_groups(offers).collect()}
    items = audit.duplicate_items(offers).collect()
    assert len(items) == sum(groups.values())


def test_schema_profile(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": "x"}], "c": null}',), ("not json",)], "j string")
    got = {(r["path"], r["type"]): r["count"] for r in audit.schema_profile(df, "j").collect()}
    assert got[("$", "OBJECT")] == 1 and got[("a[]", "BIGINT")] == 1 and got[("a[].b", "STRING")] == 1 and got[("c", "VOID")] == 1
