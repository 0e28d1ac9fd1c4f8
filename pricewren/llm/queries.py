"""The registered queries of the operators: production parameters, whole tables, the digests that the contracts ask for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm import (
    byte_bpe, collocations, decontaminate, hard_negatives, html_extract, language_id, line_dedup, near_dup, ngram_lm, pii,
    quality_rules, substring_dedup, url_filter,
)
from pricewren.llm.common import remainder, table
from pricewren.llm.url_filter import Rule

#: Fixed rules of the URL filter, and the method's own, which decide where none of them fits.
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
URL_FALLBACK = [
    Rule("block", pattern="/login/"), Rule("block", pattern="/cart/"), Rule("block", pattern="/wp-admin/"),
    Rule("block", pattern=".casino."), Rule("block", pattern=".doubleclick."), Rule("block", pattern="/ads/*.js?"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, URL_RULES, URL_FALLBACK)
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules, ["page_id"])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])
    return byte_bpe.decode(ids, ranks).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(byte_bpe.ids_text(F.col("token_ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs), ["doc_id"])
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[number(kind) for kind in pii.KINDS],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, with the items: one row per document and item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.predict(rows, model, ["doc_id", "held_out"])


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    model = ngram_lm.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    scored = ngram_lm.score(rows, model, ["doc_id", "held_out"])
    return scored.withColumn("train_tokens", F.lit(model.total).cast("long"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.group(table(spark, sf_dir, "documents"), size=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_extract.extract(pages, html_extract.fit(pages, keys=("page_id",)), ["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", changed), F.col("id") % 100 == 0)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dup": op8_near_dup,
    "op9_html_extract": op9_html_extract,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
