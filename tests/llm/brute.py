"""Plain restatements of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, fold=False):
    text = text or ""
    if fold:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def remove_repeats(rows, size):
    starts = Counter()
    for _, text in rows:
        own = words(text)
        starts.update(tuple(own[k : k + size]) for k in range(len(own) - size + 1))
    out = []
    for doc_id, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for k in range(len(own) - size + 1):
            if starts[tuple(own[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        out.append((doc_id, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, size=5):
    own = words(text, fold=True)
    if not own:
        return frozenset()
    if len(own) < size:
        return frozenset([tuple(own)])
    return frozenset(tuple(own[k : k + size]) for k in range(len(own) - size + 1))


def components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for group in holders.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= 75 * len(x | y):
                        lo, hi = sorted((root(sets[a][0]), root(sets[b][0])))
                        parent[hi] = lo
    return [(d, len(s), root(d)) for d, s in sets]
