"""Sources and sinks as round trips: the tables' rows are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricewren.session import shared_folder
from pricewren.sources import readers, writers
from pricewren.workload.registry import query
from pricewren.workload.views import offers_view, table, with_offers


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _write_feed(spark, sf, path, array):
    """Part as JSON lines: even keys as bare offers, odd keys inside a container array."""
    offer = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("product"), F.col("p_retailprice").cast("string").alias("price"),
    )
    bare = F.to_json(offer)
    inside = F.to_json(F.struct(F.array(offer).alias(array)))
    lines = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, bare).otherwise(inside).alias("value"))
    lines.write.text(path)


_PARTS = "SELECT p_partkey::VARCHAR AS id, p_name AS product, p_retailprice AS price FROM part"


@query("read_offers_lenient", _PARTS)
def read_offers_lenient(spark, sf):
    path = _folder(spark)
    _write_feed(spark, sf, path, "items")
    return readers.read_offers_lenient(spark, path, lines=True).select("id", "product", F.col("price").cast("double").alias("price"))


@query("scan_offer_dir", _PARTS.replace(" FROM", ", 'a' AS folder FROM") + " UNION ALL " + _PARTS.replace(" FROM", ", 'b' AS folder FROM"))
def scan_offer_dir(spark, sf):
    """Two folders are read, a third is skipped by its name."""
    path = _folder(spark)
    for name in ("a", "b", "skipped"):
        _write_feed(spark, sf, f"{path}/{name}", "products")
    found = readers.scan_offer_dir(spark, path, skip=("skipped",), pattern="*.txt", lines=True)
    return found.select("id", "product", F.col("price").cast("double").alias("price"), F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("folder"))


@query("load_inputs", """
SELECT 'feed' AS name, count(*) AS count, false AS missing FROM part UNION ALL SELECT 'absent', 0, true WHERE (SELECT count(*) FROM part) >= 0""")
def load_inputs(spark, sf):
    path = _folder(spark)
    _write_feed(spark, sf, f"{path}/feed", "offers")
    names = ("feed", "absent")
    loaded = readers.load_inputs(
        spark, [{"name": n, "path": f"{path}/{n}"} for n in names], lambda s, p: readers.read_offers_lenient(s, p, lines=True)
    )
    rows = None
    for name in names:
        part = loaded[name].select(F.lit(name).alias("sourceFile"))
        rows = part if rows is None else rows.union(part)
    return readers.load_report(rows, spark.createDataFrame([(n,) for n in names], "name string"))


@query("read_validity_index", """
SELECT p_partkey::VARCHAR AS "klNr", '2026-05-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS "dateFrom",
 CASE WHEN p_size % 2 = 0 THEN '2026-06-01' END AS "dateTo" FROM part""")
def read_validity_index(spark, sf):
    path = _folder(spark)
    day = F.concat(F.lit("2026-05-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("klNr"), day.alias("dateFrom"), F.when(F.col("p_size") % 2 == 0, F.lit("2026-06-01")).alias("dateTo"),
    ).write.json(path)
    return readers.read_validity_index(spark, path, lines=True)


@query("write_offers", with_offers("SELECT id, chain, product, price FROM offers WHERE confidence = 'high'"))
def write_offers(spark, sf):
    """Two versions are written, v9 and then v10; the newer one is read back, without its internal columns."""
    path = _folder(spark)
    offers = offers_view(spark, sf).withColumn("debug", F.struct("price", "unitPrice"))
    writers.write_offers(writers.public_columns(offers), path, "v9")
    writers.write_offers(writers.public_columns(offers.filter("confidence = 'high'")), path, "v10")
    latest = writers.latest_version(spark, path)
    return latest.select("id", "chain", "product", "price", *[c for c in latest.columns if c == "debug"])


@query("write_json", with_offers("SELECT id, product, price FROM offers"))
def write_json(spark, sf):
    path = _folder(spark)
    writers.write_json(offers_view(spark, sf).select("id", "product", "price").withColumn("seq", F.lit(1)), path)
    stored = spark.read.json(path)
    return stored.select("id", "product", "price", *[c for c in stored.columns if c == "seq"])


@query("write_meta", with_offers("SELECT 'combined' AS source, count(*) AS count FROM offers"))
def write_meta(spark, sf):
    path = _folder(spark)
    target = writers.write_offers(offers_view(spark, sf), f"{path}/offers", "1")
    writers.write_meta(spark, target, "combined", f"{path}/meta")
    return spark.read.parquet(f"{path}/meta").select("source", "count")
