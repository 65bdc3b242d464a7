"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rules(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines, seen = 0, set()
    for line in t.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(covered), failed


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def licenses(t):
    w = ALNUM.findall(lower(t))
    places = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()]
              for i in range(len(w)) if w[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def shingles(t, k=4):
    w = WORD.findall(lower(t))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def components(rows, percent=85):
    """[(doc_id, n, component)]; rows without an id get the component of equal sets."""
    own = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in own if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, s), (j, t) in itertools.combinations([x for x in own if x[0] is not None and x[1]], 2):
        both = len(s & t)
        if 100 * both >= percent * (len(s) + len(t) - both):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    by_set = {}
    for i, s in own:
        if i is not None and s:
            by_set.setdefault(s, i)
    return [(i, len(s), root(i) if i is not None else (root(by_set[s]) if s in by_set else None)) for i, s in own]


def repeats(rows, length=100):
    """{(doc_id, text): (bytes, removed, spans, kept)}"""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                mark[s] += 1
                mark[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(mark[:-1]) > 0
        out[i, t] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()),
                     np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out
