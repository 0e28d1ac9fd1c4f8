"""Steps that must not grow faster than their tables: no broadcast of derived tables, each distinct page parsed once."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricewren import rules
from pricewren.functions import html as H
from pricewren.functions import text as T
from pricewren.functions.patterns import SPACES, opening
from pricewren.operators import extract as X, match, ordered
from pricewren.plans import audit, index, verdicts
from pricewren.workload.views import dealt_parts


def broadcast_keys(df):
    """First keys of the broadcast joins; ``word`` is that of the bit table, whose size is fixed."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"BroadcastHashJoin \[(?:cast\()?(\w+)#", plan)) - {"word", "id"}


def test_nearest_images_broadcasts_no_table_of_the_pages(spark, monkeypatch):
    monkeypatch.setattr(match, "BROADCAST_NEEDLES", 0, raising=False)
    html = "<p>kava alfa</p><img src='/i/1.jpg'>"
    pages = spark.createDataFrame([(i, "https://a.cz/p", html) for i in range(5)], "page_id long, url string, html string")
    offers = spark.createDataFrame([(i, "kava alfa") for i in range(5)], "page_id long, product string")
    found = audit.nearest_images(pages, offers)
    assert not broadcast_keys(found)
    assert sorted(r.page_id for r in found.collect()) == list(range(5))


def test_coverage_audit_broadcasts_no_table_of_the_pages(spark, monkeypatch):
    monkeypatch.setattr(match, "BROADCAST_NEEDLES", 0, raising=False)
    pages = spark.createDataFrame([(i, f"strana 50% KAVA ALFA{i} 100 g < 12,90 Kč konec") for i in range(2, 6)], "pageNumber long, text string")
    offers = spark.createDataFrame([(i, "", f"kava alfa{i}") for i in range(2, 5)], "pageNumber long, category string, product string")
    found = audit.coverage_audit(pages, offers)
    assert not broadcast_keys(found)
    assert {r.pageNumber: r.missing for r in found.collect()} == {2: 0, 3: 0, 4: 0, 5: 1}


def test_once_per_page_gives_every_copy_its_rows(spark):
    texts = ["KÁVA ALFA\n199,90 Kč\n500 g\nB\nC", "nic", None, "", "ČAJ BETA\n9,90 Kč\n20 g"]
    rows = [(i, texts[i % 5]) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, text string").repartition(3)
    once = X.once_per_page(pages, lambda p, keep: X.extract_line_windows(p, keep=keep), ["text"])
    plain = X.extract_line_windows(pages)
    assert once.columns == plain.columns and once.count() > 20
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, plain.collect()))


def test_once_per_page_parses_a_page_once(spark):
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("KÁVA ALFA").alias("text"))
    numbered = lambda p, keep: p.select(*keep, F.monotonically_increasing_id().alias("n"))
    found = X.once_per_page(pages, numbered, ["text"])
    assert found.count() == 1000 and found.select("n").distinct().count() == 1


def test_product_tiles_read_each_page_once(spark):
    plan = entry.queries()["extract_product_tiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate posexplode"):]


def test_line_windows_normalize_a_page_once(spark):
    text = "\u00a0KÁVA\u2014ALFA \t x \r\n 1\u00a0299,90\t Kč\u2003\n\t\n \ufeff500 g\nB\u2003 \u2003C\nD"
    pages = spark.createDataFrame([(1, text)], "page_id long, text string")
    found = X.extract_line_windows(pages)
    assert optimized(found).count("[ \\t]+") == 1
    rest = "1 299,90 Kč 500 g B\u2003 \u2003C D"
    assert [(r.rawContext, r.priceText, r.price, r.packageSize) for r in found.collect()] == [
        (f"KÁVA–ALFA x {rest}", "1 299,90 Kč", 1299.9, "500 g"), (rest, "1 299,90 Kč", 1299.9, "500 g"),
    ]


@pytest.mark.parametrize("name, parsed", [
    ("extract_line_windows", "array_distinct("), ("reconciled_confidence", "Generate explode"),
    ("extract_heading_blocks", "Generate posexplode"), ("extract_uppercase_lines", "Generate inline"),
])
def test_leaflet_queries_parse_distinct_pages(spark, name, parsed):
    """The step that parses stands above the distinct pages, and the feed is joined without its text."""
    plan = optimized(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "Aggregate" in plan[plan.index(parsed):] and "rightHint=(strategy=merge)" in plan


def test_an_address_is_read_once(spark):
    pages = spark.createDataFrame([("a/../b.html", "https://a.cz/x/y?z")], "href string, page string")
    resolved = pages.select(H.resolve_url(F.upper("href"), F.lower("page")).alias("u"))
    plan = resolved._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert plan.count("upper(") == 1 and plan.count("lower(") == 1
    assert resolved.first()["u"] == "https://a.cz/x/B.HTML"


def test_index_files_a_gram_once_a_block(spark, tmp_path):
    offers = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("mleko polotucne").alias("searchIndex"))
    folder = str(tmp_path / "index")
    index.write_search_index(offers, folder, buckets=4)
    filed = spark.read.parquet(f"{folder}/grams")
    assert filed.count() == filed.select("gram", "part", "block").distinct().count() <= 13 * 4 * index.BLOCKS < 13 * 5000
    assert index.search_stored(spark, folder, "ko polo").count() == 5000


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_html_lines_are_cut_in_the_whole_text(spark):
    html = "<ul><li>\u00a0Káva\t Alfa \r</li><li>-</li><li>- - x</li></ul><h2> A\u2003</h2>\n \n* &#10;\u2028konec &nbsp;"
    found = spark.createDataFrame([(html,)], "html string").select(H.html_to_lines("html").alias("lines"))
    assert SPACES not in optimized(found)
    assert found.first()["lines"] == ["Káva Alfa", "-", "- - x", "### A", "konec"]


def test_alternatives_are_tried_where_one_can_begin(spark):
    assert (opening("nízké ceny", r"<\s*N"), opening("x?y", "a"), opening("a|b"), opening(r"\d")) == ("(?=[<n])", "", "", "")
    line = "7 NÍZKÉ CENY hezky česky 69,90 BANÁNY 2 kg 1 kg 19,90 Kč MADE WITH flippingbook"
    pages = spark.createDataFrame([(1, 7, line)], "page_id long, page_number int, line string")
    found = X.extract_unit_segments(pages)
    assert opening(*rules.PAGE_SLOGANS) in optimized(found) and optimized(found).count("(?=1)") > 3
    assert [(r.product, r.packageSize, r.unitPrices, r.leadPrices) for r in found.collect()] == [("BANÁNY", "2 kg", [19.9], [69.9])]
    noise = spark.createDataFrame([("5 12x káva 7x",)], "t string").select(T.remove_page_noise("t", F.lit(5), (r"\d+x", "K?Z")).alias("t"))
    assert noise.first()["t"] == "káva"


def test_a_line_is_judged_a_start_once(spark):
    text = "12,90\r\nKÁVA ALFA\r\nrůzné druhy\nČAJ BETA\n500 g\n9,90"
    pages = spark.createDataFrame([(1, 9, text)], "page_id long, page_number int, text string")
    found = X.extract_uppercase_lines(pages)
    assert optimized(found).count(rules.UPPER_LINE) == 1
    assert [(r.line, r.product, r.packageSize, r.price) for r in found.collect()] == [
        (1, "KÁVA ALFA různé druhy", "500 g", 12.9), (3, "ČAJ BETA 500 g", "500 g", 12.9)]


def test_positions_need_no_split(spark):
    found = spark.createDataFrame([("aXbXX\n😀X c",), ("",), (None,)], "t string").select(H.match_positions("t", "(?i)x|(?<=😀X) ").alias("m"))
    assert "split(" not in optimized(found)
    assert [[tuple(m) for m in r.m] for r in found.collect()] == [[(1, "X"), (3, "X"), (4, "X"), (7, "X"), (8, " ")], [], []]


def test_classified_texts_are_read_once(spark):
    assert "Aggregate" in optimized(entry.queries()["classify_price"](spark, "/root/testdata/sf0.001"))


def test_candidates_are_built_once(spark):
    assert "Filter" not in optimized(entry.queries()["price_candidates"](spark, "/root/testdata/sf0.001"))


def test_plain_texts_skip_the_fold(spark):
    rows = spark.createDataFrame([("Plain 1-2, X",), ("Žluťoučký kůň",), ("ΑΒΓ 7",), (None,), ("",)], "t string")
    found = rows.select(T.normalize_search("t").alias("a"), T.fold_accents("t").alias("b"))
    assert optimized(found).count("octet_length") == 2
    assert [tuple(r) for r in found.collect()] == [
        ("plain 1 2 x", "Plain 1-2, X"), ("zlutoucky kun", "Zlutoucky kun"), ("αβγ 7", "ΑΒΓ 7"), ("", None), ("", "")]


def test_texts_are_cut_to_telling_words(spark):
    texts = spark.createDataFrame([(i, f"store{i} kava zrnkova kava {i}") for i in range(50)], "i long, t string")
    expected = spark.createDataFrame([("Káva zrnková",), ("čaj",)], "expected string")
    assert [r._telling for r in match.telling_words(texts, "t", expected, "expected").select("_telling").distinct().collect()] == ["kava zrnkova"]
    phrase = spark.createDataFrame([("a 12",)], "expected string")
    assert match.telling_words(texts, "t", phrase, "expected").select("_telling").distinct().count() == 50


def test_dealt_parts_stay_dealt_and_tables_fit_their_grams(spark):
    assert dealt_parts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    assert match.bits_for(0) == 10 and match.bits_for(100) == 13 and match.bits_for(10**9) == match.BITS


def test_third_feed_reads_the_offers_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(verdicts, "traced_sources", lambda sources, order: seen.update(sources) or spark.range(0).selectExpr(
        "'' as sourceFile", "id", "'' as fate", "'' as replacedBy", "'' as replacedFrom"))
    entry.queries()["traced_sources"](spark, "/root/testdata/sf0.001")
    assert "LeftSemi" not in optimized(seen["feed three"]) and "ring" not in seen["feed three"].columns


def test_a_point_is_one_row_whatever_the_levels(spark):
    ranges = [(0, 10, "a"), (5, 100, "b"), (50, 49, "reversed"), (None, 7, "null"), (90, (1 << 60) - 1, "c"), (-9, -9, "d")]
    table = spark.createDataFrame(ranges, "`from` long, `to` long, category string")
    points = [-10, -9, 0, 5, 10, 11, 89, 100, 101, 1 << 40, None, 5]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id long, page long")
    found = ordered.range_join(rows, table, point="page", first="from", last="to", order=["from", "category"], take=["category"])
    assert "Generate" not in optimized(found)
    whole = [r for r in ranges if r[0] is not None and r[0] <= r[1]]
    want = {i: min(((a, c) for a, b, c in whole if p is not None and a <= p <= b), default=(0, None))[1] for i, p in enumerate(points)}
    assert {r.id: r.category for r in found.collect()} == want


def test_starts_that_share_a_gram_are_found_by_their_whole(spark):
    """A position is looked up once a length of the starts its gram begins, not compared with each of them."""
    starts = [f"Káva alfa {i}" for i in range(300)] + ["Káva alfa", "KAVA ALFA 7 bez", "ka", "k", "Čaj", "čaj beta", "😀x", None, ""]
    texts = ["Úvod KÁVA ALFA 7 BEZ a káva  alfa 1234 konec", "kava alfa", "ČAJ BETA čaj bet", "😀x 😀", "nic", "", None, "kávička"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    table = spark.createDataFrame([(s,) for s in starts], "start string")
    found = X.extract_dictionary_blocks(pages, table)
    assert "StartsWith" not in optimized(found)
    fold = lambda s: T.normalize_for_index(F.lit(s))
    folds = spark.range(1).select(*[fold(s).alias(f"s{i}") for i, s in enumerate(starts)], *[fold(t).alias(f"t{i}") for i, t in enumerate(texts)]).first()
    key = lambda s: re.sub("[\U00010000-\U0010ffff]", "￼", s or "")
    known = {}
    for i, s in enumerate(starts):
        if key(folds[f"s{i}"]):
            known[key(folds[f"s{i}"])] = min(s, known.get(key(folds[f"s{i}"]), s))
    want = set()
    for p in range(len(texts)):
        text = key(folds[f"t{p}"])
        want |= {(p, at, known[max(fits, key=len)]) for at in range(len(text)) if (fits := [f for f in known if text.startswith(f, at)])}
    assert {(r.page_id, r.pos, r.start) for r in found.collect()} == want and len(want) == 9


def test_anchors_and_tables_move_no_needle(spark):
    """Anchors are chosen inside the needle's row; tables of bits and counts are read in place, so they may be large."""
    needles = spark.createDataFrame([(f"n{i}", [f"kava zrnkova nr{i}x", ""]) for i in range(40)], "id string, parts array<string>")
    index = match.anchor_index(needles, needle_id="id", parts="parts")
    tree = [line for line in optimized(index).split("\n") if ":" not in line.split("- ")[0] and not line.startswith(":")]
    assert not [line for line in tree if re.search(r"Join|Aggregate", line.split("[")[0].split("(")[0])]
    assert "AS _counts#" not in optimized(index)
    assert {r.id: r._gram for r in index.collect()} == {r.id: r._gram for r in index.filter("_gram like '%x' or _gram like '%nr%'").collect()}
    texts = spark.createDataFrame([(i, f"jedna kava zrnkova nr{i}x a dalsi") for i in range(60)], "tid int, text string")
    joined = match.substring_join(texts, needles, text_id="tid", text="text", needle_id="id", parts="parts")
    assert "AS _table#" not in optimized(joined)
    assert {(r.tid, r.id) for r in joined.collect()} == {(i, f"n{i}") for i in range(40)}
    assert match.bits_for(10**9, match.WIDE_BITS) == match.WIDE_BITS > match.BITS


def test_covered_names_by_words_and_by_whole(spark):
    """J6 by definition: names of two long words are sought by their words alone."""
    offers = [(1, "kava alfa mleta nr7x"), (1, "caj"), (2, "pivo svetle"), (3, ""), (3, "mleko polotucne trvanlive lahev")]
    wanted = [(1, "alfa kava"), (1, "caj zeleny"), (1, "kava"), (1, "mleta kava nr7x extra"), (2, "caj"), (2, "svetle pivo"), (9, "caj bily"),
              (9, "nr7x"), (9, "polotucne mleko lahev x"), (9, "polotucne mleko rum1"), (9, "neznamy"), (3, "lah"), (3, ""), (2, "piv sve")]
    good = spark.createDataFrame(wanted, "pageNumber int, product string")
    known = spark.createDataFrame(offers, "pageNumber int, t string")
    found = {(r.page, r.name) for r in match.already_in(good, known, F.col("t"), T.normalize_loose).collect()}
    busy = {p for p, t in offers if t}
    want = set()
    for page, name in wanted:
        long = [w for w in name.split(" ") if len(w) >= 4][:3]
        texts = [t for p, t in offers if t and (p == page or page not in busy)]
        if name and any(name in t or t in name or (len(long) >= 2 and all(w in t for w in long)) for t in texts):
            want.add((page, name))
    assert found == want and (9, "polotucne mleko lahev x") in want


def test_markers_are_looked_for_once_and_where_one_can_begin(spark, monkeypatch):
    pages = spark.createDataFrame([(2, "x za 5,90 Kč ZA 7,90 Kč < 12,90 Kč kazda 3,90 Kč\n<1,5 kč"), (3, None)], "pageNumber int, text string")
    offers = spark.createDataFrame([(2, "", "a")], "pageNumber int, category string, product string")
    found = audit.coverage_audit(pages, offers)
    assert optimized(found).count(r"za\s+") == 2  # the matches and what lies between them
    assert r"[\s\S]" not in optimized(found) and "(?=[<z])" in optimized(found)
    assert {r.pageNumber: (r.markers, r.actionMarkers) for r in found.filter("pageNumber = 2").collect()} == {2: (4, 2)}
