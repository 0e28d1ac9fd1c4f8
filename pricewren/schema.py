"""Schemas of the entities: offers, containers, pages, indexes, checks."""

from pyspark.sql import types as T

_STRINGS_BEFORE = ("id", "storeId", "chain", "storeName", "product", "brand", "description", "packageSize")

OFFER = T.StructType(
    [T.StructField(n, T.StringType()) for n in _STRINGS_BEFORE]
    + [
        T.StructField("price", T.DoubleType()),
        T.StructField("priceText", T.StringType()),
        T.StructField("unitPrice", T.DoubleType()),
    ]
    + [
        T.StructField(n, T.StringType())
        for n in ("unit", "unitText", "validFrom", "validTo", "priceType", "sourceUrl", "imageUrl", "imageAlt",
                  "pageImageUrl", "imageType", "leafletUrl", "confidence")
    ]
    + [
        T.StructField("suspect", T.BooleanType()),
        T.StructField("suspectReasons", T.ArrayType(T.StringType())),
        T.StructField("pageNumber", T.IntegerType()),
    ]
    + [T.StructField(n, T.StringType()) for n in ("rawContext", "category", "searchTerms", "compareKey", "sourceFile")]
)

# What a source may deliver before defaults apply: alternative names, loose types.
RAW_OFFER = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name in ("price", "unitPrice", "suspect", "pageNumber") else f.dataType)
        for f in OFFER.fields
    ]
    + [
        T.StructField(n, T.StringType())
        for n in ("name", "title", "image", "imageSrc", "thumbnailUrl", "productImageUrl", "page", "leafletPage",
                  "store", "source", "sourceName", "storeAddress", "sourceStoreName", "oldPrice", "klNr",
                  "leafletType")
    ]
)

_INPUT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("missing", T.BooleanType()),
    ]
)
META = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("updatedAt", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("parser", T.StringType()),
        T.StructField("inputs", T.ArrayType(_INPUT)),
    ]
)
CONTAINER = T.StructType(
    [T.StructField("meta", META)]
    + [T.StructField(n, T.ArrayType(RAW_OFFER)) for n in ("offers", "items", "products", "data")]
)
STRICT_CONTAINER = T.StructType([T.StructField("meta", META), T.StructField("offers", T.ArrayType(RAW_OFFER))])

VALIDITY = T.StructType([T.StructField(n, T.StringType()) for n in ("klNr", "dateFrom", "dateTo")])

PDF_PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("pageNumber", "page", "number", "text", "content", "rawText", "pageText")]
)
PDF_CONTAINER = T.StructType([T.StructField(n, T.ArrayType(PDF_PAGE)) for n in ("pages", "data")])

HTML_PAGE = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)
