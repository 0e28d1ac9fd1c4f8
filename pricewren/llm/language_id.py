"""Language identification by language-bitmask n-gram filters.

Each slot of the filter holds one bit per language (bit-sliced Bloom filters side by side). An n-gram of characters reads
HASHES slots; the conjunction of their masks has a bit for every language whose filter contains the n-gram. Summed over a text,
this gives one popcount per language. A filter of fill f answers f**HASHES of absent n-grams by mistake, so
a count c of n n-grams is corrected to (c - n*e)/(1 - e). The largest corrected count decides; the score is its share of all counts.

Training: the n-grams of labelled rows are counted per language. A language's filter takes an n-gram whose share of the language's
n-grams is at least MIN_RATIO of that in its best language; so words all languages share tell nothing and n-grams of one
language tell much. The labelled rows are a sample bounded by per_language documents in expectation (chosen by
a hash of the text, whole texts); counting and filter building are Spark aggregations, and the driver receives SLOTS masks
at most. Prediction reads whole texts, is one pass without a shuffle, and holds the filter and one text's n-grams.

A null text, or one without a letter, is `und` with score 0; so is every text where no row is labelled. A text whose
n-grams no filter has gets the most frequent learned language with score 0. Ties go to the language that comes first in the
alphabet. Languages are limited to MAX_LANGUAGES, else an error is raised. Repeated rows count and are predicted each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import map_slices, staged

ORDERS = (2, 3, 4)
HASHES = 3
SLOT_BITS = 20
MAX_LANGUAGES = 63
MIN_RATIO, MIN_COUNT = 0.25, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray  # uint64 per slot
    errors: np.ndarray  # per language, the share of absent n-grams that it answers by mistake
    fallback: str


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text; every run of other characters than letters counts as one space."""
    lowered = "".join([c if c.isalpha() else " " for c in text.lower()])
    points = np.frombuffer(f" {' '.join(lowered.split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for order in ORDERS:
        if len(points) >= order:
            h = np.full(len(points) - order + 1, order, np.uint64)
            for k in range(order):
                h = (h * _MIX) ^ (points[k : len(points) - order + 1 + k] + np.uint64(1))
            out.append(_finish(h))
    return np.concatenate(out)


def slots_of(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [(hashes >> np.uint64(k * SLOT_BITS)) & mask for k in range(HASHES)]


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """N-gram counts by language of one slice."""
    found = sorted(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True), key=lambda x: x[0])
    langs, grams, counts = [], [], []
    for lang, group in groupby(found, key=lambda x: x[0]):
        h, n = np.unique(np.concatenate([gram_hashes(text) for _, text in group]), return_counts=True)
        langs.append(pa.repeat(pa.scalar(lang, pa.string()), len(h)))
        grams.append(h.view(np.int64))
        counts.append(n.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(langs), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"]
    )


def fit(labelled: DataFrame, per_language: int = 2000, text: str = "text", lang: str = "lang") -> Filter:
    """A filter from the labelled rows (null texts and languages are left out)."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Filter([], np.zeros(1, np.uint64), np.zeros(0), "und")
    # Each row decides by itself with its language's rate, so no group is gathered.
    rate = F.lit(0.0)
    for name in languages:
        rate = F.when(F.col("lang") == name, min(1.0, per_language / sizes[name])).otherwise(rate)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1 << 20)) < rate * (1 << 20))
    counts = staged(map_slices(chosen, _counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.col("n") / max(1, totals.get(name, 1))).otherwise(share)
    bit = F.lit(0).cast("long")
    for k, name in enumerate(languages):
        bit = F.when(F.col("lang") == name, F.lit(1 << k).cast("long")).otherwise(bit)
    members = counts.select("gram", F.struct(share.alias("share"), bit.alias("bit"), "n").alias("of")).groupBy("gram")
    members = members.agg(F.collect_list("of").alias("of"), F.max("of.share").alias("best"))
    members = members.select("gram", F.filter("of", lambda x: (x["share"] >= MIN_RATIO * F.col("best")) & (x["n"] >= MIN_COUNT)).alias("of"))
    mask = F.aggregate("of", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["bit"])).alias("mask")
    slot = [F.shiftrightunsigned("gram", k * SLOT_BITS).bitwiseAND((1 << SLOT_BITS) - 1) for k in range(HASHES)]
    filled = members.select("gram", mask).where("mask <> 0").select("mask", F.explode(F.array(*slot)).alias("slot"))
    filled = filled.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(1 << SLOT_BITS, np.uint64)
    masks[filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    fills = np.array([np.mean((masks >> np.uint64(k)) & np.uint64(1)) for k in range(len(languages))])
    return Filter(languages, masks, fills**HASHES, min(languages, key=lambda x: (-sizes[x], x)))


def classify(text: str | None, model: Filter) -> tuple[str, float]:
    """Language and score of one text."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return "und", 0.0
    hashes = gram_hashes(text)
    masks = model.masks
    first, *rest = slots_of(hashes)
    found = masks[first]
    for slot in rest:
        found = found & masks[slot]
    n = len(hashes)
    counts = np.array([np.count_nonzero(found & np.uint64(1 << k)) for k in range(len(model.languages))], float)
    corrected = np.maximum(0, (counts - n * model.errors) / (1 - np.minimum(model.errors, 0.999)))
    total = corrected.sum()
    if total <= 0:
        return model.fallback, 0.0
    best = int(np.argmax(corrected))
    return model.languages[best], float(corrected[best] / total)


def predict(docs: DataFrame, model: Filter, keys: list[str], text: str = "text") -> DataFrame:
    """keys, lang_pred and score of every row."""
    rows = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    fields = "".join(f"`{k}` {t}, " for k, t in rows.dtypes[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**SLOT_BITS masks of 8 bytes, whatever the input

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [classify(x, shared.value) for x in batch.column("__text").to_pylist()]
        out = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*keys, "lang_pred", "score"])

    return map_slices(rows, run, f"{fields}lang_pred string, score double", "__text")
