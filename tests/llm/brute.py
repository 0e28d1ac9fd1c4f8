"""Plain Python definitions that the operators are held against."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(TO_LOWER))


def shingles(text, size):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def near_dup(docs, size, percent):
    """Component by id; docs: (id, text)."""
    sets, parent = {}, {}
    for i, text in docs:
        sets[i] = shingles(text, size)
        parent[i] = i

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def dedup_lines(docs):
    """(kept text, dropped lines) by id; docs: (id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(TO_LOWER)
    first, seen = {}, {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 10:
                seen.setdefault(k, set()).add(i)
    first = {k: min(v) for k, v in seen.items() if len(v) > 1}
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out[i] = ("\n".join(kept), len(lines) - len(kept))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = WORD.findall(text or "")
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [2 * int(c) if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def pii(text):
    out = {}
    for kind, pattern in PII.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else True,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append(m.span())
    return out
