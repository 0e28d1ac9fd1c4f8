"""The corpus pipeline: documents through five operators, each stage on all that its predecessor kept.

A stage is (name, function(spark, docs, sf_dir) -> DataFrame). All but the last return the columns of documents. Every stage is
written as Parquet and read again as the next one's input.

Further columns of the input, whatever their names, pass through all stages unchanged; the last one's token_ids and n_tokens replace columns of
these names. Rows without an id or a text are kept or dropped as each operator's docstring says. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm import byte_bpe, decontaminate, line_dedup, near_dup, quality_rules
from pricewren.llm.common import shared_dir, table

#: SQL can express neither the near-duplicate groups nor byte-pair merges; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def _hidden(docs: DataFrame, shown: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all but the shown columns under private names, and the names by column: an operator's own columns can't clash."""
    names = {c: c if c in shown else f"__column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()]), names


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text."""
    hidden, names = _hidden(docs, ("doc_id", "text"))
    kept = line_dedup.dedup_lines(hidden)
    size = F.length("text").cast("long")
    return kept.select(*[size.alias(c) if c == "n_chars" else F.col(name).alias(c) for c, name in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates (five words, similarity 0.8)."""
    return near_dup.keep_one(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, token_ids and n_tokens; the text is the one decoded from the ids."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    hidden, names = _hidden(docs, ("text",))
    rest = [name for name in hidden.columns if name != "text"]
    both = byte_bpe.decode(byte_bpe.encode(hidden, ranks, public_tokenizers.PATTERN, rest), ranks)
    kept = {c: name for c, name in names.items() if c not in ("token_ids", "n_tokens")}
    return both.select(
        *[F.col("decoded").cast("string").alias("text") if c == "text" else F.col(name).alias(c) for c, name in kept.items()],
        "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
    )


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dup", near_duplicates),
    ("decontaminate", decontaminated),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
