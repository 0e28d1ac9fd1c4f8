"""Quality rules by host (built-in functions only).

Each document is measured against fixed rules. The failures of a rule set are summed by host, and the host's failure
rate is shrunk towards all hosts: with a beta prior of mean m and strength s, both taken from the hosts by moments,
rate = (failures + s*m) / (documents + s). So a host with few documents says little and a large one speaks for
itself. The host verdict is `reject` at a rate of reject_rate or more, `watch` at watch_rate or more, else `trust`, and is
joined back: a base failure always rejects a document; on a watched host a document that fails one of the soft
rules goes too; on a rejected host every document goes.

The sums are combined before the shuffle, so a host with a third of all rows is one row per task. Of the prior, two
numbers come to the driver. Host rows are joined by Spark's own choice (a skewed join is split at run time).

A null text counts as a text without words, which fails the base rules. A null host is a host of its own. Repeated
rows count and stay each for themselves. Empty tables give empty results. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import SPACE, bound, staged, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Fixed bounds of the soft rules: share of symbols, mean word length, share of repeated lines and of repeated words.
MAX_SYMBOL_SHARE, MIN_WORD_LENGTH, MAX_WORD_LENGTH = 0.10, 2.0, 15.0
MAX_DUP_LINE_SHARE, MAX_REPEAT_SHARE = 0.30, 0.20


def repeated_words(hashes: Column) -> Column:
    """Number of words that stand in a window of WINDOW words found twice or more; hashes has one value per word.

    Window hashes come from pairs of pairs of pairs. Where all differ the answer is 0. Else windows are sorted as
    (hash, position), neighbours of the same hash are repeats, and the sorted positions of repeats cover
    min(WINDOW, gap to the next repeat) words each. Linear but for the two sorts, whatever the text's length.
    """

    def windows(h: Column) -> Column:
        def pair(span: int):
            later = lambda x: F.slice(x, span + 1, F.greatest(F.size(x) - span, F.lit(0)))
            return lambda x: F.zip_with(x, later(x), lambda a, b: F.xxhash64(a, b))

        wide = pair(4)
        paired = bound(bound(pair(1)(h), pair(2)), wide)
        # The last windows lack words; zip_with has filled them up with nulls.
        return F.slice(paired, 1, F.size(h) - (WINDOW - 1))

    def repeats(pairs: Column) -> Column:
        at = lambda i: F.get(pairs, i)["h"]
        kept = F.filter(pairs, lambda p, i: F.coalesce(p["h"] == at(i - 1), F.lit(False)) | F.coalesce(p["h"] == at(i + 1), F.lit(False)))
        return F.sort_array(F.transform(kept, lambda p: p["at"]))

    def covered(at: Column) -> Column:
        # F.get gives null beyond the end, and least() skips it.
        gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.get(at, i + 1) - p))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def of_windows(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bound(bound(pairs, repeats), covered))

    def count(h: Column) -> Column:
        return F.when(F.size(h) > WINDOW, bound(windows(h), of_windows)).otherwise(F.lit(0))

    return bound(hashes, count).cast("long")


def measure(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the base measures of the whole text of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keys, body.alias("__text"), words(body).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda line: F.regexp_like(line, F.lit(SPACE.replace("[", "[^"))))
    # All symbols are single bytes, so a difference of byte lengths counts them.
    symbols = sum((F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    rows = rows.select(
        *keys,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("long").alias("__distinct_lines"),
        repeated_words(hashes).alias("n_repeat_words"),
    )
    rows = rows.withColumn("n_dup_lines", F.col("n_lines") - F.col("__distinct_lines")).drop("__distinct_lines")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def soft_failed() -> Column:
    """Whether a measured document breaks one of the soft rules."""
    return (
        (F.col("n_words") == 0)
        | (F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars"))
        | (F.col("word_chars") < MIN_WORD_LENGTH * F.col("n_words"))
        | (F.col("word_chars") > MAX_WORD_LENGTH * F.col("n_words"))
        | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))
        | (F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    )


def host_verdicts(measured: DataFrame, host: str, reject_rate: float = 0.9, watch_rate: float = 0.5) -> DataFrame:
    """One row per host: host, n_docs, n_failed, rate, host_verdict."""
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = measured.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    # Moments over hosts: a beta of mean m and variance v has the strength m(1-m)/v - 1. Two numbers come to the driver.
    mean, variance = hosts.agg(F.avg(share), F.var_pop(share)).first()
    mean, spread = mean or 0.0, (mean or 0.0) * (1 - (mean or 0.0))
    strength = spread / variance - 1 if variance and variance < spread else 1.0
    rate = (F.col("n_failed") + strength * mean) / (F.col("n_docs") + strength)
    verdict = F.when(F.col("rate") >= reject_rate, "reject").when(F.col("rate") >= watch_rate, "watch").otherwise("trust")
    return hosts.select(host, "n_docs", "n_failed", rate.alias("rate")).withColumn("host_verdict", verdict)


def _with_verdicts(measured: DataFrame) -> DataFrame:
    """A written table of measures with __host, joined with the host verdicts: host_rate, host_verdict, kept."""
    hosts = host_verdicts(measured, "__host").select(F.col("__host").alias("__of"), F.col("rate").alias("host_rate"), "host_verdict")
    gone = F.col("base_failed") | (F.col("host_verdict") == "reject") | ((F.col("host_verdict") == "watch") & F.col("soft_failed"))
    joined = measured.join(hosts, F.col("__host").eqNullSafe(F.col("__of")), "left")
    return joined.drop("__host", "__of").withColumn("kept", ~gone)


def judge(docs: DataFrame, keys: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """Every row: keys, the base measures, base_failed, soft_failed, host_rate, host_verdict, kept."""
    rows = docs.select(*keys, F.col(host).alias("__host"), F.col(text).alias("__body"))
    measured = measure(rows, [*keys, "__host"], "__body").withColumn("soft_failed", soft_failed())
    # Written once, the measures serve both the host sums and the join back.
    return _with_verdicts(staged(measured))


def keep(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    rows = docs.select(row, F.col(host).alias("__host"), F.col(text).alias("__body"))
    measured = measure(rows, ["__row", "__host"], "__body").withColumn("soft_failed", soft_failed())
    return _with_verdicts(staged(measured)).where("kept").select("__row.*")
