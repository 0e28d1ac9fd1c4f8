import json

import pytest
from pyspark.sql import functions as F

from pricewren.functions.names import row_id
from pricewren.sources import readers, writers
from pricewren.streaming.ingest import ingest, page_stream


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


OFFER = {"id": "1", "product": "Máslo", "price": 49.9, "suspect": True, "suspectReasons": ["x"]}


def test_containers(spark, tmp_path):
    path = write(tmp_path / "a.json", {"meta": {"count": 2}, "offers": [OFFER, {**OFFER, "id": "2"}]})
    got = readers.read_offers(spark, path).orderBy("seq").collect()
    assert [(r["seq"], r["id"], r["price"], r["suspect"]) for r in got] == [(0, "1", "49.9", "true"), (1, "2", "49.9", "true")]
    for shape in ({"items": [OFFER]}, {"data": [OFFER]}, [OFFER], {"offers": [OFFER]}):
        path = write(tmp_path / "b.json", shape)
        assert [r["product"] for r in readers.read_offers_lenient(spark, path).collect()] == ["Máslo"]
    path = write(tmp_path / "c.json", {"products": [OFFER]})
    assert readers.read_offers_lenient(spark, path).count() == 0
    assert readers.read_offers_lenient(spark, path, products=True).count() == 1


def test_optional_inputs(spark, tmp_path):
    path = write(tmp_path / "a.json", {"offers": [OFFER]})
    loaded = readers.load_inputs(spark, [{"name": "a", "path": path}, {"name": "b", "path": str(tmp_path / "none.json")}])
    assert loaded["a"].count() == 1 and loaded["b"].count() == 0
    with pytest.raises(FileNotFoundError):
        readers.load_inputs(spark, [{"name": "b", "path": str(tmp_path / "none.json"), "required": True}])
    rows = loaded["a"].withColumn("sourceFile", F.lit("a"))
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    report = {r["name"]: (r["count"], r["missing"]) for r in readers.load_report(rows, names).collect()}
    assert report == {"a": (1, False), "b": (0, True)}


def test_directory_scan(spark, tmp_path):
    write(tmp_path / "x" / "a.json", {"offers": [OFFER]})
    write(tmp_path / "x" / "deep" / "b.json", [OFFER, OFFER])
    write(tmp_path / "x" / "skipped" / "c.json", {"offers": [OFFER]})
    write(tmp_path / "x" / "d.txt", "no json")
    got = readers.scan_offer_dir(spark, str(tmp_path / "x"), skip=["skipped"])
    counts = {r["file"].rsplit("/", 1)[-1]: r["count"] for r in got.groupBy("file").count().collect()}
    assert counts == {"a.json": 1, "b.json": 2}


def test_pages(spark, tmp_path):
    path = write(tmp_path / "p.json", {"pages": [{"pageNumber": 3, "text": "tři"}, {"page": 9, "content": "devět"}, {"rawText": " "}, {"pageText": "čtyři"}]})
    got = sorted((r["pageNumber"], r["text"]) for r in readers.read_pdf_pages(spark, path).collect())
    assert got == [(3, "tři"), (4, "čtyři"), (9, "devět")]
    write(tmp_path / "t" / "leaflet.txt", "první\fdruhá\nstrana\f")
    pages = readers.read_text_pages(spark, str(tmp_path / "t")).orderBy("page_number").collect()
    assert [(p["page_number"], p["text"]) for p in pages] == [(1, "první"), (2, "druhá\nstrana"), (3, "")]
    write(tmp_path / "h" / "page-17.html", "<p>x</p>")
    assert readers.read_html_files(spark, str(tmp_path / "h")).first()["page_id"] == 17
    path = write(tmp_path / "v.json", [{"klNr": "5", "dateFrom": "2026-05-13", "dateTo": "2026-05-19"}])
    assert readers.read_validity_index(spark, path).first()["dateTo"] == "2026-05-19"


def test_versions_are_immutable(spark, tmp_path):
    df = spark.createDataFrame([("1", "Chain A", "Máslo", 1), ("2", "Chain B", "Sýr", 2)], "id string, chain string, product string, debug int")
    root = str(tmp_path / "offers")
    writers.write_offers(writers.public_columns(df), root, "001")
    writers.write_offers(writers.public_columns(df.filter("id = '1'")), root, "002")
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_offers(df, root, "002")
    latest = writers.latest_version(spark, root)
    assert latest.count() == 1 and "debug" not in latest.columns
    meta = writers.write_meta(spark, f"{root}/version=001", "combined", str(tmp_path / "meta")).first()
    assert meta["count"] == 2


def test_stream_appends_only_new_names_and_survives_replay(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def extract(pages):
        return pages.select(row_id("p-", F.col("page_id")).alias("id"), "page_id", F.col("html").alias("product"), F.lit(1.0).alias("price"), F.lit("s").alias("storeId"))

    def arrive(rows):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(source)

    def run():
        ingest(page_stream(spark, source), target, checkpoint, extract, ("page_id",)).awaitTermination()
        return sorted(r["product"] for r in spark.read.parquet(target).collect())

    arrive([(1, "u", "Máslo"), (2, "u", "maslo"), (3, "u", "Sýr")])
    assert run() == ["Máslo", "Sýr"]
    arrive([(4, "u", "SÝR"), (5, "u", "Káva")])
    assert run() == ["Káva", "Máslo", "Sýr"]
    assert run() == ["Káva", "Máslo", "Sýr"]
    # A fresh checkpoint on the existing table reads all pages again: nothing is lost and nothing is added twice.
    checkpoint = str(tmp_path / "check2")
    arrive([(6, "u", "Chléb")])
    assert run() == ["Chléb", "Káva", "Máslo", "Sýr"]
