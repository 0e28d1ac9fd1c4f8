"""The stored search index answers as a scan does, and reads a fraction of its files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pricewren.plans import index, serve


def test_index_search_equals_scan(spark, tmp_path):
    rnd = random.Random(3)
    words = ["aaa", "aaaa", "mleko", "maslo", "a", "ab", "12", "polotucne", "b ab a"]
    rows = [(f"o{i}", " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))) for i in range(400)]
    offers = spark.createDataFrame(rows, "id string, searchIndex string")
    folder = str(tmp_path / "index")
    index.write_search_index(offers, folder, buckets=16)
    queries = ["aaa", "aaaaa", "máslo", "mleko maslo", "ab a", "a", "ab", "", "nic takového", "polotucne 12", "aaa aaa"]
    for q in queries:
        want = {r.id for r in serve.search(offers, q).collect()}
        assert {r.id for r in index.search_stored(spark, folder, q).collect()} == want, q
    counted = {r["query"]: r.matches for r in index.count_stored(spark, folder, queries).collect()}
    assert counted == {q: serve.search(offers, q).count() for q in queries}


def test_index_reads_a_fraction_of_the_files(spark, tmp_path):
    offers = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("zbozi "), F.md5(F.col("id").cast("string"))).alias("searchIndex"))
    folder = str(tmp_path / "index")
    index.write_search_index(offers, folder, buckets=64)
    one = offers.first()
    found = index.search_stored(spark, folder, one.searchIndex[6:26])
    assert [r.id for r in found.collect()] == [one.id]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part#" in plan or "PartitionFilters: [(part#" in plan
    scans = index.matching_ids(spark, folder, [one.searchIndex[6:26]])
    scans.collect()
    every = spark.read.parquet(f"{folder}/grams").select("bucket").distinct().count()
    read = spark.read.parquet(f"{folder}/grams").filter(F.col("bucket").isin([0])).select("bucket").distinct().count()
    assert every > 30 and read <= 1
