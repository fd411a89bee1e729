"""Brute-force versions of the operators, for small documents."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def runs(covered) -> list[tuple[int, int]]:
    out, start = [], None
    for k, c in enumerate([*covered, False]):
        if c and start is None:
            start = k
        elif not c and start is not None:
            out.append((start, k))
            start = None
    return out


def substrings(rows, window=50):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    first: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i, len(w), tuple(runs(gone)), sha(b" ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


def suffixes(rows, window=200):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = Counter()
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        out[i, len(t), tuple(runs(gone)), sha(bytes(x for x, g in zip(t, gone) if not g))] += 1
    return out


def near_duplicates(rows, width, percent=80):
    """(id, size of the set, smallest id of its component) by row."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least: dict[int, int | None] = defaultdict(lambda: None)
    for k, r in enumerate(rows):
        if r[0] is not None and (least[find(k)] is None or r[0] < least[find(k)]):
            least[find(k)] = r[0]
    return [(r[0], len(sets[k]), least[find(k)] if sets[k] else r[0]) for k, r in enumerate(rows)]
