"""The pipeline with columns whose names its stages use themselves."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

SAMPLE = "/root/testdata/sf0.001"


def test_clashing_columns_pass_through(spark, tmp_path):
    plain = docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    clashing = ("token_ids", "n_tokens", "decoded", "n_lines", "n_dropped", "id", "component_id", "kept", "n_words", "t_a")
    docs = docs.withColumns({c: F.lit("mine") for c in clashing})
    for name, stage in corpus_pipeline.STAGES:
        for kind, table in (("a", plain), ("b", docs)):
            stage(spark, table, SAMPLE).write.parquet(str(tmp_path / f"{name}-{kind}"))
        plain, docs = (spark.read.parquet(str(tmp_path / f"{name}-{kind}")) for kind in "ab")
        assert docs.columns == [c for c in docs.columns if c in plain.columns or c in clashing] and len(set(docs.columns)) == len(docs.columns)
    columns = ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(plain) == rows(docs)
    assert docs.where(" AND ".join(f"{c} = 'mine'" for c in clashing[2:])).count() == docs.count()
