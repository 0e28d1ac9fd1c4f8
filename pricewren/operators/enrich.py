"""Offer enrichment (rows E1-E12 of the inventory): DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pricewren import rules
from pricewren.functions.money import number_text, to_number
from pricewren.functions.names import clean_product_name
from pricewren.functions.patterns import quote, word
from pricewren.functions.quality import is_true
from pricewren.functions.text import (
    first_text, let, normalize_ascii, normalize_loose, normalize_search, not_blank, text_of,
)
from pricewren.operators.ordered import range_join


def present(df: DataFrame, fields: Sequence[str]) -> list[Column]:
    """The columns of ``df`` among ``fields``, in the given order."""
    return [F.col(f) for f in fields if f in df.columns]


def joined_text(df: DataFrame, fields: Sequence[str] = rules.SEARCH_FIELDS) -> Column:
    """Non-empty text and array fields joined by one blank."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    parts = [F.col(f) if f in arrays else not_blank(f) for f in fields if f in df.columns]
    return F.concat_ws(" ", *parts)


def canonical_store_id(offers: DataFrame, aliases: DataFrame, column: str = "storeId") -> DataFrame:
    """Replace alias ids by canonical ones (``aliases(alias, id)``).

    A plain equi join: the optimizer broadcasts the aliases when they are small
    and shuffles when they are not.
    """
    lookup = aliases.select(F.col("alias").alias("_alias"), F.col("id").alias("_canonical")).dropDuplicates(["_alias"])
    return (
        offers.join(lookup, offers[column] == F.col("_alias"), "left")
        .withColumn(column, F.coalesce("_canonical", column))
        .drop("_alias", "_canonical")
    )


def normalize_offer(offers: DataFrame, source: str | Column) -> DataFrame:
    """Every canonical field with its default; missing columns are added.

    ``||`` fallbacks skip empty text, ``??`` fallbacks only null.  A missing
    price stays null (it never turns into 0).
    """
    name = F.lit(source) if isinstance(source, str) else source

    def has(field: str) -> Column:
        return F.col(field) if field in offers.columns else F.lit(None).cast("string")

    level = F.lower(text_of(has("confidence")))
    image_type = (
        F.when(text_of(has("pageImageUrl")) != "", F.lit("page-thumbnail"))
        .when(text_of(has("imageUrl")) != "", F.lit("product"))
        .otherwise(F.lit(""))
    )
    price = to_number(has("price"))
    reasons = has("suspectReasons") if "suspectReasons" in offers.columns else F.lit(None).cast("array<string>")
    terms = offers.schema["searchTerms"].dataType.typeName() if "searchTerms" in offers.columns else "string"
    defaults = {
        "id": first_text(has("id"), F.concat(name, F.lit("-"), text_of(has("product")), F.lit("-"), number_text(price))),
        "storeId": first_text(has("storeId"), F.regexp_replace(F.lower(name), r"\s+", "-")),
        "chain": first_text(has("chain"), name),
        "storeName": first_text(has("storeName"), name),
        "price": price,
        "unitPrice": F.coalesce(to_number(has("unitPrice")), price),
        "unit": first_text(has("unit"), F.lit("Kč/ks")),
        "priceType": first_text(has("priceType"), F.lit("akce")),
        "imageUrl": first_text(*[has(f) for f in ("imageUrl", "image", "imageSrc", "thumbnailUrl", "productImageUrl")]),
        "imageAlt": first_text(has("imageAlt"), has("product")),
        "imageType": first_text(has("imageType"), image_type),
        "confidence": F.when(level.isin("high", "medium", "low"), level).otherwise(F.lit("high")),
        "suspect": is_true(has("suspect")),
        "suspectReasons": F.coalesce(reasons, F.array().cast("array<string>")),
        "pageNumber": has("pageNumber").try_cast("double").try_cast("int"),
        "searchTerms": F.concat_ws(" ", has("searchTerms")) if terms == "array" else text_of(has("searchTerms")),
        "sourceFile": name,
    }
    plain = (
        "product", "brand", "description", "packageSize", "priceText", "unitText", "validFrom", "validTo", "sourceUrl",
        "pageImageUrl", "leafletUrl", "rawContext", "category", "compareKey",
    )
    defaults.update({field: text_of(has(field)) for field in plain})
    return offers.withColumns(defaults)


def with_search_index(offers: DataFrame, fields: Sequence[str] = rules.SEARCH_FIELDS) -> DataFrame:
    """``searchIndex``, the T1 form of all text fields."""
    return offers.withColumn("searchIndex", normalize_ascii(joined_text(offers, fields)))


def has_term(text: Column, terms: Sequence[str]) -> Column:
    """Any of the (accent-folded) terms occurs in accent-folded text."""
    return text.rlike("|".join(quote(t) for t in terms))


def tag_by_dictionary(text: Column, dictionary: Sequence[tuple[str, Sequence[str]]], default: str = "") -> Column:
    """Label of the first entry (in order) with a term in ``text``.

    Terms are folded here, once, so each entry is a single regex alternation.
    """

    def first_label(folded: Column) -> Column:
        label = F.lit(default)
        for name, terms in reversed(list(dictionary)):
            label = F.when(has_term(folded, [fold_term(t) for t in terms]), F.lit(name)).otherwise(label)
        return label

    return let(text, first_label)


def fold_term(term: str) -> str:
    """Accent-folded lower-case form of a literal dictionary term."""
    import unicodedata

    base = "".join(ch for ch in unicodedata.normalize("NFD", term) if not 0x0300 <= ord(ch) <= 0x036F)
    return " ".join(base.lower().split())


def is_beer(product: Column, description: Column, context: Column) -> Column:
    """Beer by keyword or brand."""
    return let(
        F.concat_ws(" ", text_of(product), text_of(description), text_of(context)),
        lambda text: text.rlike(rules.BEER_WORDS) | text.rlike(word(*[quote(b) for b in rules.BEER_BRANDS])),
    )


def beer_description(product: Column, description: Column, context: Column) -> Column:
    """Kind of beer by degree and wording."""

    def kind_of(text: Column) -> Column:
        kind = F.lit(rules.BEER_DEFAULT)
        for pattern, name in reversed(rules.BEER_KINDS):
            kind = F.when(text.rlike(pattern), F.lit(name)).otherwise(kind)
        return kind

    return let(F.concat_ws(" ", text_of(product), text_of(description), text_of(context)), kind_of)


def search_terms(*parts: Column) -> Column:
    """E5: distinct tokens over the parts, first occurrence first."""
    text = F.concat_ws(" ", *[not_blank(p) for p in parts])
    return F.array_join(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != "")), " ")


def compare_key(product: Column, package: Column) -> Column:
    """T1 of name and package without filler words; the name alone if empty."""
    key = normalize_ascii(F.concat_ws(" ", text_of(product), text_of(package)))
    stopwords = rf"\b(?:{'|'.join(rules.COMPARE_STOPWORDS)})\b"
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(key, stopwords, " "), " +", " "))
    return let(cleaned, lambda k: F.coalesce(not_blank(k), normalize_ascii(product)))


def enrich_offer(offers: DataFrame) -> DataFrame:
    """Row of D1: clean name, beer tagging, search terms and compare key."""
    named = offers.withColumn("product", clean_product_name("product"))
    fields = (F.col("product"), F.col("description"), F.col("rawContext"))
    tagged = named.withColumns({"_beer": is_beer(*fields), "_kind": beer_description(*fields)})
    bare = F.col("_beer") & ~text_of("description").rlike(rules.BEER_IN_DESCRIPTION)
    described = tagged.withColumns(
        {
            "description": F.when(bare, F.concat_ws("; ", "_kind", not_blank("description"))).otherwise(F.col("description")),
            "category": F.when(F.col("_beer"), first_text("category", F.lit("pivo"))).otherwise(F.col("category")),
            # Search terms keep the description as it was before tagging.
            "_plain": F.col("description"),
        }
    )
    extra = F.when(F.col("_beer"), F.concat_ws(" ", *[F.lit(t) for t in rules.BEER_SEARCH_TERMS], "_kind"))
    parts = [F.col(c) for c in ("product", "brand", "_plain", "packageSize", "chain", "storeName")]
    return described.withColumns(
        {
            "searchTerms": search_terms(*parts, extra),
            "compareKey": compare_key(F.col("product"), F.col("packageSize")),
        }
    ).drop("_beer", "_kind", "_plain")


def guess_category(product: Column, context: Column, dictionary=rules.CATEGORY_RULES) -> Column:
    """First category whose terms occur in the name or context."""
    return tag_by_dictionary(normalize_loose(F.concat_ws(" ", text_of(product), text_of(context))), dictionary)


def category_by_page_range(page: Column, product: Column, ranges=rules.PAGE_CATEGORIES, texts=rules.TEXT_CATEGORIES) -> Column:
    """Category of the page range, else of the product text.

    The ranges are a fixed short list, so the range join is a ``CASE``.
    """

    def by_text(name: Column) -> Column:
        found = F.lit("")
        for pattern, category, _ in reversed(texts):
            found = F.when(name.rlike(pattern), F.lit(category)).otherwise(found)
        return found

    label = let(normalize_search(product), by_text)
    for first, last, category, _ in reversed(ranges):
        label = F.when(page.between(first, last), F.lit(category)).otherwise(label)
    return label


def category_by_ranges(offers: DataFrame, ranges: DataFrame, page: str = "pageNumber") -> DataFrame:
    """E8 for a ranges *table* ``(from, to, category)`` of any size and width.

    The first range (by ``from``, then category) wins where ranges overlap; see ``ordered.range_join``.
    """
    named = ranges.withColumnRenamed("category", "rangeCategory")
    return range_join(offers, named, point=page, first="from", last="to", order=["from", "rangeCategory"], take=["rangeCategory"])


def terms_for_category(product: Column, category: Column) -> Column:
    """Distinct search terms that go with a category and a name."""
    name = normalize_loose(product)
    parts = [F.array_compact(F.array(not_blank(category)))]
    for value, terms in rules.CATEGORY_TERMS:
        parts.append(F.when(category == value, F.array(*[F.lit(t) for t in terms])))
    for pattern, terms in rules.PRODUCT_TERMS:
        parts.append(F.when(name.rlike(pattern), F.array(*[F.lit(t) for t in terms])))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(p, empty) for p in parts]))


def image_audit(offers: DataFrame, fields: Sequence[str] = rules.IMAGE_FIELDS) -> DataFrame:
    """``imageFields``, the image fields an offer fills, with their values."""
    entries = []
    for field in fields:
        value = not_blank(field) if field in offers.columns else F.lit(None).cast("string")
        entries += [F.lit(field), value]
    found = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    return offers.withColumn("imageFields", found)
