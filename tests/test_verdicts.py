"""Verdicts of the audits on small tables where every branch occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewren.plans import verdicts


def _offers(spark, rows):
    return spark.createDataFrame(rows, "seq int, id string, storeId string, product string, price double, suspect boolean, rawContext string")


def test_every_lost_row_has_its_reason(spark):
    first = _offers(spark, [
        (1, "a", "s", "Káva Alfa", 10.0, False, ""), (2, "b", "s", "Káva Alfa", 10.0, False, ""), (3, "c", "s", "Sýr", None, False, ""),
        (4, "d", "s", "Mléko", 5.0, True, ""), (5, "e", "s", "Chléb", 7.0, False, "dnes vezměte si z regálu"), (6, "f", "s", "", 3.0, False, ""),
        (7, "a", "s", "Káva Alfa", 10.0, False, ""),
    ])
    second = _offers(spark, [(1, "g", "s", "Káva Alfa", 10.0, False, ""), (2, "h", "s", "Máslo", 9.0, False, "")])
    traced = verdicts.traced_sources({"one": first, "two": second})
    got = {(r.sourceFile, r.seq): (r.fate, r.replacedBy, r.replacedFrom) for r in traced.collect()}
    gone = ("replaced", "g", "two")
    assert got == {
        ("one", 1): gone, ("one", 2): gone, ("one", 7): gone, ("one", 3): ("no-price", None, None), ("one", 4): ("suspect", None, None),
        ("one", 5): ("marketing", None, None), ("one", 6): ("no-product", None, None), ("two", 1): ("kept", None, None), ("two", 2): ("kept", None, None),
    }
    assert verdicts.lost_rows({"one": first, "two": second}).count() == 7
    assert verdicts.traced_sources({"one": first.filter("false")}).count() == 0


def test_reconcile_tells_changes_apart(spark):
    before = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None), (3, 3.0, "c")], "k int, price double, name string")
    after = spark.createDataFrame([(1, 1.0, "a"), (2, 2.5, "b"), (4, 4.0, "d")], "k int, price double, name string")
    got = {r.k: (r.status, r.changed) for r in verdicts.reconcile_tables(before, after, ["k"], ["price", "name"]).collect()}
    assert got == {1: ("same", []), 2: ("changed", ["price", "name"]), 3: ("lost", []), 4: ("new", [])}


def test_import_problems_of_all_kinds(spark):
    schema = "chain string, product string, category string"
    source = spark.createDataFrame([("A", f"pivo {i}", "") for i in range(7)] + [("A", "Braník", "")] + [("B", "Braník", "pivo")], schema)
    combined = spark.createDataFrame([("A", "mléko", ""), ("B", "Braník", "")], schema)
    added = spark.createDataFrame([("B", 5)], "chain string, added long")
    got = {(r.chain, r.problem) for r in verdicts.import_problems(source, combined, ["chain"], term="pivo", product="branik", added=added).collect()}
    assert got == {
        ("A", "in-source-not-in-combined"), ("A", "product-lost"), ("B", "missing-in-source"), ("B", "product-without-search-term"),
        ("B", "reported-added-but-absent"),
    }


def test_search_and_image_verdicts(spark):
    counts = spark.createDataFrame([("Pivo", 3, 0), ("braník", 2, 2), ("káva", 4, 0), ("nic", 0, 0)], "query string, full int, productOnly int")
    got = {(r.query, r.problem) for r in verdicts.search_verdicts(counts, main="pivo", pair=("branik", "pivo")).collect()}
    hidden = "full-search-finds-results-but-product-only-does-not"
    assert got == {("Pivo", hidden), ("káva", hidden), ("Pivo", "pivo-only-in-metadata"), ("branik/pivo", "data-search-ok")}
    offers = spark.createDataFrame([("a", "x.jpg"), ("b", ""), ("c", None)], "chain string, imageUrl string")
    images = spark.createDataFrame([("b", "https://x/product/1.jpg"), ("c", "https://x/leaflet/1.jpg"), ("d", "https://x/logo.png")], "chain string, imageUrl string")
    paths = {r.chain: r.recommendedPath for r in verdicts.image_paths(offers, images, images.filter("false")).collect()}
    assert paths == {
        "a": "use-existing-offer-image-fields", "b": "map-product-images-from-html", "c": "page-image-crops-or-no-product-images",
        "d": "no-direct-product-images-found",
    }


def test_noise_summary_of_the_whole_table(spark):
    rows = [(1, 20, "ok", 1.0, ""), (1, 5, "záloha na lahev x", 1.0, "c"), (2, 5, "dobré zboží", 1.0, "c"), (2, 5, "dobré zboží", 1.0, "c")]
    offers = spark.createDataFrame(rows, "g int, pageNumber int, product string, price double, category string")
    whole = verdicts.noise_summary(offers).first()
    assert (whole.totalOffers, whole.exactDuplicateGroups, whole.recommendedPath) == (4, 1, "inspect-remove-candidates-then-build-cleanup-patch")
    assert {r.g: r.recommendedPath for r in verdicts.noise_summary(offers.filter("product <> 'záloha na lahev x'"), ["g"]).collect()}[2] == "no-critical-noise-found"


def test_store_endpoints_and_leaflets(spark):
    html = "<i a='/kloffers.json' b='" + "store" * 80 + "' c='https://x.cz/leaflet'></i><a href='/a'>Prolistovat</a><a href='/b'>jinam</a>"
    row = spark.createDataFrame([(html,)], "h string").select(
        verdicts.store_endpoints("h", F.lit("https://a.cz/p/")).alias("e"), F.transform(verdicts.leaflet_links("h"), lambda a: a["href"]).alias("l")
    ).first()
    assert row.e == ["https://a.cz/kloffers.json", "https://x.cz/leaflet"] and row.l == ["/a"]
