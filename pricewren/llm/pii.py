"""Personal data: candidate spans scored by gradient-boosted trees.

Base spans follow fixed patterns and checks per kind (email, ip, card, phone) and always stay. Beyond them, generators of high recall
propose spans that may overlap: obfuscated addresses, digits in any grouping, numbers without a country code, addresses
with a port or of version 6. Each candidate becomes format features (digits, groups, separators, checksum, ...) and context
features (kinds of the neighbouring characters and key words before it). Boosted trees per kind give a probability, which is
calibrated on rows the trees haven't seen, and a span is added where it reaches the kind's threshold: the least at
which held-out precision is `precision`. What overlaps a base span of any kind isn't added; of overlapping others of a kind the more probable wins.

No labelled personal data exists, so positives are made: base spans of a sample are rewritten in place as people hide or regroup them (at and
dot as words or in brackets, other separators, version 6, national numbers), and the candidate that covers the rewritten span is positive, in
its own context. Candidates of the unchanged texts that touch no base span of their kind are negative, and so are look-alikes (amounts, times,
dates, device numbers) put in the place of base spans. What defines the base (an at sign, the checksum, parts
up to 255, a plus sign with country code) is no feature. The sample has max_documents documents and max_candidates distinct feature vectors
of a kind in expectation, chosen by hashes of rows and of vectors, so copies don't enlarge it; whole texts. Thresholds of 1 (nothing is added)
hold where a kind has fewer than MIN_EXAMPLES of either label.

Texts are processed whole, one at a time, and nothing is shuffled. All searches are linear in the text. A null text is the empty text
and has no spans. Repeated rows each get their spans. Empty tables give empty results. Positions count code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.boosting import Trees, calibrate, fit_trees, precise_threshold
from pricewren.llm.common import map_slices, staged

KINDS = ("email", "ip", "card", "phone")
MIN_EXAMPLES = 20

#: Fixed patterns of the base. A run of digits or of address characters is entered at its start only, so no search is quadratic.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators beyond the base, one pattern for each kind.
_MORE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s{0,2}(?:@|[\[({]\s?at\s?[\])}]|\sat\s)\s{0,2}"
        r"[A-Za-z0-9-]{1,63}+(?:\s{0,2}(?:\.|[\[({]\s?dot\s?[\])}]|\sdot\s)\s{0,2}[A-Za-z0-9-]{1,63}+){1,8}"
    ),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}|(?<![0-9])[0-9]{1,3}+(?:\s?[.,]\s?[0-9]{1,3}+){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{1,8}+(?:[\x20._/-]{0,2}[0-9]{1,8}+){1,8}"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,5}+\)?(?:[\x20./-]{0,2}\(?[0-9]{1,5}+\)?){1,6}"),
}
_NEEDS = {"email": re.compile(r"@|[\s\[({]at[\s\])}]"), "ip": re.compile(r"[0-9:]"), "card": re.compile("[0-9]"), "phone": re.compile("[0-9]")}
_NATIONAL = re.compile(r"\+?[0-9]{1,3}[\x20.-]+(?=\(?[0-9])")
#: Fixed key words, looked for in the characters before a candidate.
_KEYS = {
    "email": re.compile(r"e-?mail|contact|write|mailto|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|addr|gateway|\bfrom\b", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|cell|telefon|tél|whatsapp", re.I),
}
#: Characters around a rewritten span that its features are taken with.
_CONTEXT = 120
#: Times that one feature vector counts at most.
_MOST_COPIES = 50
#: Words and brackets that stand for signs in hidden addresses.
_SENTENCE = re.compile(r"\.\s")
_WORDS, _BRACKETS = re.compile(r"\b(?:at|dot)\b"), re.compile(r"[\[({]\s?(?:at|dot)\s?[\])}]")
_BEFORE = 40
_HEX = frozenset("abcdefABCDEF")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind."""
    emails, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            emails.append((start, end := domain.end()))
        at = text.find("@", max(at + 1, end))
    ips = [m.span() for m in _IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def candidates(text: str, kind: str) -> list[tuple[int, int]]:
    """Spans that the generators of a kind propose; they may overlap."""
    # A text without what every match needs is passed over.
    if not _NEEDS[kind].search(text):
        return []
    found = []
    for m in _MORE[kind].finditer(text):
        begin, end = m.span()
        if kind in ("card", "phone"):
            n = sum("0" <= c <= "9" for c in m[0])
            if not (12 <= n <= 20 if kind == "card" else 7 <= n <= 16):
                continue
            if kind == "phone" and (inner := _NATIONAL.match(m[0])) and len(_digits(m[0][inner.end() :])) >= 7:
                found.append((begin + inner.end(), end))
        found.append((begin, end))
    return found


def features(text: str, kind: str, begin: int, end: int) -> list[float]:
    """Format and context features of one candidate."""
    span = text[begin:end]
    # What defines the base doesn't tell: a plus sign and country code are left out.
    core = span[m.end() :] if kind == "phone" and (m := _NATIONAL.match(span)) else span
    digits = _digits(core)
    groups = re.findall(r"[0-9]+", core)
    letters = sum(c.isalpha() for c in core)
    before, after = text[begin - 1 : begin], text[end : end + 1]
    return [
        len(core), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), letters,
        core.count("."), core.count("-"), core.count(" "), core.count("(") + core.count("["), core.count(":"), core.count(",") + core.count("_") + core.count("/"),
        len(_WORDS.findall(core)), core.count("dot"), len(_SENTENCE.findall(core)), len(_BRACKETS.findall(core)), max(map(len, re.findall(r"[A-Za-z]+", core)), default=0),
        float(digits[:1] == "0"), float(before.isalnum()), float(after.isalnum()), float(before in _HEX and before != ""), float(after in _HEX and after != ""),
        float(before in "=\"'#:/" and before != ""), float(_KEYS[kind].search(text, max(0, begin - _BEFORE), begin) is not None),
    ]


@dataclass
class Model:
    trees: dict[str, Trees] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)


def spans(text: str | None, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans in order of kind and start."""
    if not text:
        return {k: [] for k in KINDS}, []
    base = base_spans(text)
    every = _merged(sorted(s for found in base.values() for s in found))
    out = []
    for kind in KINDS:
        taken = sorted(base[kind])
        if kind in model.trees:
            proposed = _apart(sorted(set(candidates(text, kind))), every)
            if proposed:
                p = model.trees[kind].probability(np.array([features(text, kind, *s) for s in proposed]))
                good = [(-x, s) for x, s in zip(p, proposed, strict=True) if x >= model.thresholds[kind]]
                taken = _chosen(sorted(good), taken)
        out += [(kind, *s) for s in taken]
    return base, out


def _apart(proposed: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Proposed spans (sorted) that overlap none of the taken ones (sorted, apart)."""
    out, k = [], 0
    for begin, end in proposed:
        while k < len(taken) and taken[k][1] <= begin:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            out.append((begin, end))
    return out


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for begin, end in found:
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _chosen(ranked: list[tuple[float, tuple[int, int]]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """taken and, in order of rank, the spans that overlap nothing chosen before. Candidates of a kind are short, so marks by position do."""
    marks: set[int] = set()
    for begin, end in taken:
        marks.update((begin, end - 1))
    out = list(taken)
    for _, (begin, end) in ranked:
        if marks.isdisjoint(range(begin, end)):
            marks.update(range(begin, end))
            out.append((begin, end))
    return sorted(out)


_N_FEATURES = len(features("1", "phone", 0, 1))
_ROWS = "kind string, label int, x array<double>"


def rewritten(kind: str, span: str) -> list[str]:
    """Other ways to write a base span, as the generators propose them."""
    if kind == "email":
        local, domain = span.split("@")
        parts, plain = domain.split("."), re.sub(r"[^A-Za-z]", "", local) or "a"
        return [
            f"{local} [at] {' [dot] '.join(parts)}", f"{local} at {' dot '.join(parts)}", f"{local}(at){domain}", f"{local} {{at}} {' dot '.join(parts)}",
            f"{local}[at]{'[dot]'.join(parts)}", f"{local} (at) {' (dot) '.join(parts)}", f"{plain} [at] {' [dot] '.join(parts[-2:])}",
            f"{plain} at {' dot '.join(parts[-2:])}", f"{plain}(at){'.'.join(parts[-2:])}",
        ]
    if kind == "ip":
        parts = span.split(".")
        word = xxhash.xxh3_64_hexdigest(span.encode())
        six = [word[k : k + 4] for k in range(0, 16, 4)]
        return [",".join(parts), " . ".join(parts), ", ".join(parts), ":".join(["2001", "db8", *six, *six[:2]]), ":".join(["fe80", "", *six])]
    digits = _digits(span)
    if kind == "card":
        groups = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return ["_".join(groups), "/".join(groups), ".".join(groups), "  ".join(groups), "--".join(groups)]
    national = digits[-10:]
    if len(digits) < 9:
        return []
    area, first, last = national[:-7], national[-7:-4], national[-4:]
    return [f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area} {first} {last}", f"{area}/{first}-{last}", f"00{digits[:-10] or 1} {area} {first} {last}"]


def look_alikes(kind: str, span: str) -> list[str]:
    """Things that are no personal data and that the generators of a kind propose: amounts, times, dates, device and order numbers."""
    word = xxhash.xxh3_128_hexdigest(span.encode())
    d = str(int(word, 16))[1:]
    if kind == "ip":
        return [f"{d[0]},{d[1:4]},{d[4:7]},{d[7:10]}", ":".join(word[k : k + 2] for k in range(0, 12, 2)), f"{d[:2]}:{d[2:4]}:{d[4:6]}", f"{d[:2]}:{d[2:4]}:{d[4:6]}:{d[6:8]}"]
    if kind == "card":
        return [f"{d[:16]}", f"{d[:2]}.{d[2:4]}.{d[4:8]} {d[8:10]}.{d[10:12]}.{d[12:16]}", f"{d[:3]} {d[3:6]} {d[6:9]} {d[9:12]} {d[12:15]}", f"{d[:6]}/{d[6:10]}-{d[10:14]}"]
    if kind == "phone":
        return [f"20{d[:2]}-{d[2:4]}-{d[4:6]}", f"{d[:2]}.{d[2:4]}.20{d[4:6]}", f"{d[0]} {d[1:4]} {d[4:7]}.{d[7:9]}", f"{d[:9]}", f"{d[:14]}", f"{d[:4]}/{d[4:8]}"]
    return [f"seen at {word[:5]}. Then", f"{word[:4]} at {word[4:9]}. {word[9:12]}"]


def _examples(batch: pa.RecordBatch) -> pa.RecordBatch:
    kinds, labels, rows = [], [], []

    def add(kind: str, label: int, text: str, span: tuple[int, int]) -> None:
        kinds.append(kind)
        labels.append(label)
        rows.append(features(text, kind, *span))

    for text in batch.column("text").to_pylist():
        base = base_spans(text)
        for kind in KINDS:
            taken = sorted(base[kind])
            for span in _apart(sorted(set(candidates(text, kind))), taken):
                add(kind, 0, text, span)
            for begin, end in taken:
                before, after = text[max(0, begin - _CONTEXT) : begin], text[end : end + _CONTEXT]
                for label, other in [*((1, x) for x in rewritten(kind, text[begin:end])), *((0, x) for x in look_alikes(kind, text[begin:end]))]:
                    changed = before + other + after
                    for a, b in candidates(changed, kind):
                        if (a, b) == (len(before), len(before) + len(other)) or not label and a < len(before) + len(other) and b > len(before):
                            add(kind, label, changed, (a, b))
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["kind", "label", "x"]
    )


def fit(docs: DataFrame, text: str = "text", max_documents: int = 4000, max_candidates: int = 4000, precision: float = 0.98) -> Model:
    """Trees and thresholds by kind."""
    # Only texts with a digit or an at sign can hold a base span.
    rows = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    rate = min(1.0, max_documents / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(3), F.monotonically_increasing_id()), F.lit(1 << 20)) < rate * (1 << 20))
    found = staged(map_slices(chosen, _examples, _ROWS).groupBy("kind", "label", "x").agg(F.count("*").alias("n")))
    sizes = {(r["kind"], r["label"]): r["n"] for r in found.groupBy("kind", "label").agg(F.sum(F.least("n", F.lit(_MOST_COPIES))).alias("n")).collect()}
    model = Model()
    for kind in KINDS:
        if min(sizes.get((kind, 0), 0), sizes.get((kind, 1), 0)) < MIN_EXAMPLES:
            continue
        share = min(1.0, max_candidates / (sizes[kind, 0] + sizes[kind, 1]))
        picked = F.pmod(F.hash("x"), F.lit(1 << 20)) < share * (1 << 20)
        table = found.where((F.col("kind") == kind) & picked).select("label", "x", F.hash("x").alias("h"), F.least("n", F.lit(_MOST_COPIES)).alias("n")).toArrow()
        order = np.lexsort((table["label"].to_numpy(), table["h"].to_numpy()))  # as the rows come from any task first
        copies = table["n"].to_numpy()[order]
        copy = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        order = np.repeat(order, copies)
        x = np.array(table["x"].to_pylist(), float).reshape(-1, _N_FEATURES)[order]
        y, h = table["label"].to_numpy()[order].astype(float), table["h"].to_numpy()[order]
        later = ((h + copy) % 3) == 0  # occurrences held out for calibration
        if min(y[~later].sum(), (1 - y[~later]).sum(), y[later].sum(), (1 - y[later]).sum()) < 1:
            continue
        trees = fit_trees(x[~later], y[~later])
        calibrate(trees, x[later], y[later])
        model.trees[kind] = trees
        model.thresholds[kind] = max(0.9, precise_threshold(trees.probability(x[later]), y[later], precision))
    return model


def find(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """keys, base and spans of every row, arrays of struct(kind, start, end) by kind and start."""
    rows = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    fields = "".join(f"`{k}` {t}, " for k, t in rows.dtypes[:-1])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    shown = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base_out, all_out = [], []
        for value in batch.column("__text").to_pylist():
            base, found = spans(value, model)
            base_out.append(shown([(k, *s) for k in KINDS for s in base[k]]))
            all_out.append(shown(found))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base_out, kind), pa.array(all_out, kind)], names=[*keys, "base", "spans"])

    one = "array<struct<kind:string,start:int,end:int>>"
    return map_slices(rows, run, f"{fields}base {one}, spans {one}", "__text")


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans of several kinds are one, under the first."""
    out, at = [], 0
    for kind, begin, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_text(found):
    """kind:start:end joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
