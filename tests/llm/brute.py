"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, k):
    w = words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs, k, percent=80):
    """docs: [(id, text)] -> {id: component}."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def repeated(texts, window):
    """For each text the mask of its words that windows which recur cover."""
    w = [words(t) for t in texts]
    seen = Counter(tuple(x[i : i + window]) for x in w for i in range(len(x) - window + 1))
    out = []
    for x in w:
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if seen[tuple(x[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((x, gone))
    return out
