"""Plain single-machine versions that the corpus operators are held against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def op3(rows, window=35):
    count = Counter()
    for _, text in rows:
        w = words(text)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def op10(rows, k=2, percent=80):
    sets = {d: shingles(t, k) for d, t in rows}
    where = defaultdict(list)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = defaultdict(Counter)
    for d, s in sorted(sets.items()):
        seen = Counter()
        for x in s:
            seen.update(where[x])
            where[x].append(d)
        shared[d] = seen
    for d, seen in shared.items():
        for e, n in seen.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return [(d, len(sets[d]), root(d), root(d) == d) for d in sets]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
