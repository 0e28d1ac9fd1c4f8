"""Streaming ingestion of the pages table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricewren.functions import html as H
from pricewren.functions.names import row_id
from pricewren.session import shared_folder
from pricewren.streaming.ingest import ingest, page_stream
from pricewren.workload.registry import query
from pricewren.workload.views import squeeze_sql, t3, table


def headlines(pages):
    """A minimal extractor: the page title as an offer name."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return pages.select(
        row_id("page-", F.col("page_id")).alias("id"), F.col("page_id"), H.clean_fragment(title).alias("product"), F.lit(1.0).alias("price"),
        F.lit("web").alias("storeId"),
    )


_TITLE = squeeze_sql("""regexp_replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&amp;', '&'), '<[^>]+>', ' ', 'g')""")


@query("stream_ingest", f"""
SELECT count(*) AS offers, count(DISTINCT name) AS names FROM (SELECT min(page_id) AS page_id, name FROM (SELECT page_id, {t3(_TITLE)} AS name FROM pages) WHERE name <> '' GROUP BY name)""")
def stream_ingest(spark, sf):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # Six files, one per micro batch, so that later batches meet the names of earlier ones.
    table(spark, sf, "pages").repartition(6, "page_id").write.parquet(f"{folder}/pages")
    pages = page_stream(spark, f"{folder}/pages", files_per_batch=1)
    ingest(pages, f"{folder}/offers", f"{folder}/checkpoint", headlines, order=("page_id",)).awaitTermination()
    from pricewren.operators.dedupe import loose_name

    stored = spark.read.parquet(f"{folder}/offers").filter(loose_name() != "")
    return stored.agg(F.count(F.lit(1)).alias("offers"), F.countDistinct(loose_name()).alias("names"))
