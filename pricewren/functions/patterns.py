"""Regex fragments shared by the column functions.

Java's ``\\b`` changed its idea of a letter between JDKs, so words are always
delimited with explicit Unicode look-arounds.  ``(?iu)`` is needed because
``(?i)`` alone folds ASCII only.
"""

from __future__ import annotations

import re

EDGE_L = r"(?<![\p{L}\p{N}_])"
EDGE_R = r"(?![\p{L}\p{N}_])"

# White space in the JavaScript sense: Unicode white space and the byte-order mark
# (Java's \s alone is ASCII only; (?U:..) makes it one cheap Unicode test).
SPACES = r"(?U:[\s\ufeff]+)"
SPACES_OR_NONE = r"(?U:[\s\ufeff]*)"
BLANKS = " \t\n\r\f\x0b\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# An upper-case letter that can open a Czech product name.
UPPER = "A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
LETTER = "A-Za-zÁČĎÉĚÍŇÓŘŠŤÚŮÝŽáčďéěíňóřšťúůýž"

# 12,90 / 1 299,00 (comma decimals, optional thousands groups)
AMOUNT = r"\d{1,4}(?:\s?\d{3})*,\d{2}"
LOOSE_AMOUNT = r"\d{1,4}(?:\s?\d{3})*(?:,\d{1,2})?"


def bare_word(*alternatives: str) -> str:
    """Pattern (without flags) matching any alternative as a whole word."""
    return f"{EDGE_L}(?:{'|'.join(alternatives)}){EDGE_R}"


def word(*alternatives: str) -> str:
    """Case-insensitive pattern matching any alternative as a whole word."""
    return f"(?iu){bare_word(*alternatives)}"


def starts(*alternatives: str) -> str:
    """Case-insensitive pattern matching any alternative at the start."""
    return f"(?iu)^(?:{'|'.join(alternatives)})"


def exactly(*alternatives: str) -> str:
    """Case-insensitive pattern matching any alternative as the whole text."""
    return f"(?iu)^(?:{'|'.join(alternatives)})$"


def opening(*alternatives: str) -> str:
    """Look-ahead for the first character of the alternatives, empty unless all of them begin with a plain one.

    It goes in front of the alternatives: at most places of a text one test replaces one for each of them.
    """
    plain = all(re.match(r"[\w<](?![?*{])[^|]*$", a) for a in alternatives)
    return f"(?=[{''.join(sorted({a[0] for a in alternatives}))}])" if plain else ""


def quote(text: str) -> str:
    """Escape a literal for use inside a Java pattern."""
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\/" else ch for ch in text)
