"""Reading offers and pages (rows S1-S9 of the inventory)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricewren import schema
from pricewren.functions.text import normalize_text


def explode_container(documents: DataFrame, arrays: Sequence[str] = ("offers",)) -> DataFrame:
    """Rows of the first array a container fills, with their position."""
    rows = F.coalesce(*[F.col(a) for a in arrays])
    return documents.select(F.posexplode(rows).alias("seq", "_o")).select(F.col("seq").cast("bigint").alias("seq"), "_o.*")


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offers of one JSON container (``{meta, offers}``)."""
    documents = spark.read.schema(schema.STRICT_CONTAINER).option("multiLine", True).json(path)
    return explode_container(documents)


def read_offers_lenient(spark: SparkSession, path: str, products: bool = False, lines: bool = False) -> DataFrame:
    """Offers of a bare array or of ``offers`` / ``items`` / ``products`` / ``data``.

    ``lines``: the files hold one document per line, so a large feed is split over many tasks.

    With a container schema a top-level array reads as one document per element
    whose container arrays are all missing; those elements are offers themselves.
    """
    known = ("offers", "items", "products", "data") if products else ("offers", "items", "data")
    fields = [f for f in schema.CONTAINER.fields if f.name in known or f.name == "meta"]
    loose = type(schema.CONTAINER)(fields + list(schema.RAW_OFFER.fields))
    documents = spark.read.schema(loose).option("multiLine", not lines).json(path)
    return flatten_documents(documents, known)


def flatten_documents(documents: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Offers of containers and bare offers in one pass."""
    names = [f.name for f in schema.RAW_OFFER.fields]
    own = F.array(F.struct(*names))
    inside = F.coalesce(*[F.col(a) for a in arrays])
    bare = F.greatest(*[F.col(n).isNotNull() for n in ("product", "name", "title", "id", "price")])
    rows = F.when(inside.isNotNull(), inside).when(bare, own).otherwise(F.array().cast(schema.CONTAINER["offers"].dataType))
    return documents.select(F.explode(rows).alias("_o")).select("_o.*")


def offers_from_json(documents: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """S1 / S2 over a column of container texts."""
    parsed = documents.select(*keep, F.from_json(json, schema.CONTAINER).alias("_c"))
    rows = F.coalesce(*[F.col(f"_c.{a}") for a in ("offers", "items", "data", "products")])
    return parsed.select(*keep, F.posexplode(rows).alias("seq", "_o")).select(*keep, "seq", "_o.*")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` (or anything that a pattern fits) exists, on any file system; nothing below it is listed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def load_inputs(spark: SparkSession, inputs: Sequence[Mapping], reader=read_offers) -> dict[str, DataFrame]:
    """S3: offers per input; a missing optional file is an empty source.

    Each input is ``{name, path, required}``.
    """
    loaded = {}
    for item in inputs:
        if path_exists(spark, item["path"]):
            loaded[item["name"]] = reader(spark, item["path"])
        elif item.get("required"):
            raise FileNotFoundError(f"missing required input: {item['path']}")
        else:
            empty = [schema.T.StructField("seq", schema.T.LongType()), *schema.RAW_OFFER.fields]
            loaded[item["name"]] = spark.createDataFrame([], schema.T.StructType(empty))
    return loaded


def load_report(offers: DataFrame, inputs: DataFrame, source: str = "sourceFile") -> DataFrame:
    """S3: rows per expected input (``inputs(name)``), zero and missing included."""
    counts = offers.groupBy(F.col(source).alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return inputs.join(counts, "name", "left").select(
        "name", F.coalesce("count", F.lit(0)).alias("count"), F.col("count").isNull().alias("missing")
    )


def scan_offer_dir(spark: SparkSession, path: str, skip: Sequence[str] = (), pattern: str = "*.json", lines: bool = False) -> DataFrame:
    """Offers of every JSON file under a directory, tagged with their file (``lines``: one document per line).

    Files inside a directory named in ``skip`` are left out by file path.
    """
    known = ("offers", "items", "products", "data")
    loose = type(schema.CONTAINER)(list(schema.CONTAINER.fields) + list(schema.RAW_OFFER.fields))
    documents = (
        spark.read.schema(loose).option("multiLine", not lines).option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    )
    for name in skip:
        documents = documents.filter(~F.contains("_file", F.lit(f"/{name}/")))
    names = [f.name for f in schema.RAW_OFFER.fields]
    inside = F.coalesce(*[F.col(a) for a in known])
    bare = F.greatest(*[F.col(n).isNotNull() for n in ("product", "name", "title", "price")])
    rows = F.coalesce(inside, F.when(bare, F.array(F.struct(*names))))
    return documents.select(F.col("_file").alias("_f"), F.explode(rows).alias("_o")).select("_o.*", F.col("_f").alias("file"))


def pages_from_items(items: DataFrame, position: Column) -> DataFrame:
    """Page number and text under their alternative names, blank pages dropped."""
    number = F.coalesce(*[F.col(c).try_cast("int") for c in ("pageNumber", "page", "number")], position)
    text = F.coalesce("text", "content", "rawText", "pageText", F.lit(""))
    return items.select(number.alias("pageNumber"), text.alias("text")).filter(F.trim("text") != "")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts of a JSON container (``{pages: [...]}`` or ``{data: [...]}``)."""
    documents = spark.read.schema(schema.PDF_CONTAINER).option("multiLine", True).json(path)
    items = documents.select(F.posexplode(F.coalesce("pages", "data")).alias("_i", "_p")).select("_i", "_p.*")
    return pages_from_items(items, F.col("_i") + 1)


def split_pages(documents: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Form-feed separated text -> numbered, normalised pages."""
    return documents.select(*keep, F.posexplode(F.split(text, "\f")).alias("_i", "_t")).select(
        *keep, (F.col("_i") + 1).alias("page_number"), normalize_text("_t").alias("text")
    )


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of whole text files, tagged with their file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return split_pages(files, keep=("file",))


def read_html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Already fetched pages (parquet: page id, url, html)."""
    return spark.read.schema(schema.HTML_PAGE).parquet(path)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Already fetched HTML files; the page number comes from the file name."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).try_cast("bigint").alias("page_id"),
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"),
    )


def read_validity_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Article validity rows of a JSON array, or of JSON lines."""
    return spark.read.schema(schema.VALIDITY).option("multiLine", not lines).json(path)


def flatten_json_index(documents: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """Items of a top-level array, or of all array values of an object.

    Items stay JSON text; ``seq`` is their position in the document.
    """
    array = F.from_json(F.col(json), "array<string>")
    by_key = F.from_json(F.col(json), "map<string,array<string>>")
    items = F.when(F.ltrim(F.col(json)).startswith("["), array).otherwise(F.flatten(F.map_values(by_key)))
    return documents.select(*keep, F.posexplode(items).alias("seq", "item")).filter(F.ltrim("item").startswith("{"))

