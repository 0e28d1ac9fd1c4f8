"""Text normalisation columns (rows T1-T6, T8, T19-T22 of the inventory)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F

from pricewren.functions.patterns import BLANKS, SPACES, SPACES_OR_NONE, opening
from pricewren.rules import PAGE_SLOGANS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """The value as text, null becoming the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used.

    A column expression is a tree: naming a sub-expression twice computes it
    twice wherever common sub-expressions are not eliminated (conditional
    branches, lambdas).  Binding it to a lambda variable computes it once.
    """
    return F.transform(F.array(value), lambda v: use(v))[0]


def each(values: Column, build: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """Map an array and optionally drop elements, all inside one expression.

    A filter placed on a derived column would be pushed below the projection and
    repeat the derivation; dropping elements before the generator does not.
    """
    built = F.transform(values, lambda v: build(v))
    return built if keep is None else F.filter(built, lambda v: keep(v))


@lru_cache(maxsize=1)
def _fold_alphabet() -> tuple[str, str]:
    """Translate table: every precomposed letter to its base, marks deleted.

    Derived from Unicode canonical decomposition, so it equals "decompose, then
    drop the combining marks" without a UDF.  ``translate`` deletes source
    characters that have no counterpart, which removes free-standing marks.
    """
    marks = [chr(cp) for cp in range(0x0300, 0x0370)]
    source, target = [], []
    for cp in range(0x00C0, 0x2C00):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if parts != ch and ch not in marks and all(p in marks for p in parts[1:]):
            source.append(ch)
            target.append(parts[0])
    return "".join(source + marks), "".join(target)


def fold_accents(c: Column | str) -> Column:
    """Replace accented letters by their base letter, one for one; text of one byte a character has none."""
    source, target = _fold_alphabet()
    return let(col(c), lambda v: F.when(F.octet_length(v) == F.char_length(v), v).otherwise(F.translate(v, source, target)))


def squeeze(c: Column | str) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def not_blank(c: Column | str) -> Column:
    """Null for null and for the empty string (the falsy-string rule)."""
    return F.nullif(text_of(c), F.lit(""))


def first_text(*columns: Column | str) -> Column:
    """First non-empty text, or the empty string."""
    return F.coalesce(*[not_blank(c) for c in columns], F.lit(""))


def normalize_ascii(c: Column | str) -> Column:
    """Lower case, no accents, only ``a-z0-9`` words joined by one blank."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(text_of(c))), "[^a-z0-9]+", " "))


def normalize_search(c: Column | str) -> Column:
    """Like T1 but keeps letters and digits of every script."""
    def folded(v: Column) -> Column:
        plain = F.regexp_replace(F.lower(v), "[^a-z0-9]+", " ")  # the same for text of one byte a character, at less cost
        source, target = _fold_alphabet()
        return F.when(F.octet_length(v) == F.char_length(v), plain).otherwise(
            F.regexp_replace(F.lower(F.translate(v, source, target)), r"[^\p{L}\p{N}]+", " ")
        )

    return F.trim(let(text_of(c), folded))


def normalize_loose(c: Column | str) -> Column:
    """Lower case, no accents, single blanks, punctuation kept."""
    return squeeze(F.lower(fold_accents(text_of(c))))


def normalize_for_index(c: Column | str) -> Column:
    """T4: position-preserving fold (precomposed text): accents, case, dashes."""
    return F.translate(F.lower(fold_accents(text_of(c))), "–—", "--")


def normalize_text(c: Column | str) -> Column:
    """T5: plain blanks, one dash form, no carriage returns, line breaks kept."""
    unified = text_of(c)
    for char, by in (("\u00a0", " "), ("\u2014", "\u2013"), ("\r", "")):
        unified = F.replace(unified, F.lit(char), F.lit(by))
    return strip(F.regexp_replace(unified, r"[ \t]+", " "))


def as_normalized(c: Column | str, normalized: bool) -> Column:
    """T5, skipped for text that a caller has normalised already."""
    return text_of(c) if normalized else normalize_text(c)


def normalize_line(c: Column | str) -> Column:
    """T5 for one line; a leading dash is dropped, a leading bullet kept."""
    return let(
        normalize_text(c),
        lambda line: squeeze(
            F.when(F.startswith(line, F.lit("•")), F.regexp_replace(line, f"^•{SPACES_OR_NONE}", "• "))
            .otherwise(F.regexp_replace(line, f"^-{SPACES_OR_NONE}", ""))
        ),
    )


def compact_text(c: Column | str) -> Column:
    """One line of text: line breaks become `` | ``, blanks are squeezed."""
    return squeeze(F.regexp_replace(text_of(c), r"\r?\n", " | "))


def single_line(c: Column | str) -> Column:
    """T5 plus squeezing of every kind of white space."""
    return squeeze(F.replace(text_of(c), F.lit("—"), F.lit("–")))


def decode_url(c: Column | str, rounds: int = 6) -> Column:
    """Repeated percent-decoding until it fails or changes nothing.

    ``+`` is protected because URI decoding leaves it alone.  Once a round
    fails the value stays as it is, so later rounds are no-ops.
    """
    def once(value: Column, _: Column) -> Column:
        shielded = F.replace(value, F.lit("+"), F.lit("%2B"))
        return F.coalesce(F.try_url_decode(shielded), value)

    text = text_of(c)
    return F.when(
        F.contains(text, F.lit("%")), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), text, once)
    ).otherwise(text)


def snippet(text: Column | str, term: Column, radius: int = 350) -> Column:
    """The text around the accent-insensitive first hit of ``term``."""
    needle = F.lower(fold_accents(text_of(term)))
    return let(
        single_line(text),
        lambda source: let(
            F.instr(F.lower(fold_accents(source)), needle),
            lambda at: _window(source, at, F.length(needle), radius, radius),
        ),
    )


def context_around(text: Column | str, at: Column, radius: int = 650) -> Column:
    """Compacted text around the 1-based position ``at`` (empty if 0)."""
    def cut(position: Column) -> Column:
        start = F.greatest(position - radius, F.lit(1))
        around = compact_text(F.substring(text_of(text), start, position + radius - start))
        return F.when(position > 0, around).otherwise(F.lit(""))

    return let(at, cut)


def flexible_position(text: Column | str, words: Column) -> Column:
    """1-based position where the normalised words follow each other.

    Up to 80 characters of anything may stand between two words; 0 if absent.
    """
    pattern = F.concat(F.lit("(?i)"), F.regexp_replace(words, " +", r"[\\s\\S]{0,80}"))
    return F.when(words != "", F.regexp_instr(normalize_for_index(text), pattern)).otherwise(F.lit(0))


def remove_page_noise(
    text: Column | str, page_number: Column, slogans: tuple[str, ...] = PAGE_SLOGANS
) -> Column:
    """Drop the leading page number, slogans, footers and watermark."""
    value = text_of(text)
    value = F.regexp_replace(value, F.concat(F.lit(r"^\s*"), page_number.cast("string"), F.lit(r"\s+")), F.lit(""))
    return squeeze(F.regexp_replace(value, f"(?iu){opening(*slogans)}(?:{'|'.join(slogans)})", " "))


def longest_price_line(lines: Column) -> Column:
    """The longest line that carries a price (earliest on a tie)."""
    priced = F.filter(
        lines,
        lambda line: line.rlike(r"\d{1,4},\d{2}") & line.rlike("(?iu)Kč|Nabídka platná|cena za"),
    )
    ranked = F.transform(
        priced, lambda line, pos: F.struct(F.length(line).alias("size"), (-pos).alias("rank"), line.alias("line"))
    )
    return F.coalesce(F.array_max(ranked)["line"], F.lit(""))


def _window(source: Column, at: Column, width: Column | int, before: int, after: int) -> Column:
    """Substring from ``before`` characters ahead of ``at`` to ``after`` past its end."""
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(source, start, at + width + after - start)).otherwise(F.lit(""))
