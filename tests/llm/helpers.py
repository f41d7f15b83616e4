"""Brute-force counterparts of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \n\t ", "one", "two words", "\u00e9" * 50, "x" * 3000, "word " * 3000]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def classes(nodes, linked):
    """Smallest member of each node's component."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def without_repeats(texts, least):
    """(bytes, removed, spans, hash of the rest) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + least] for b in data for p in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out
