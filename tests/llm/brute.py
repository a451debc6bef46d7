"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict


def kept_lines(docs):
    """docs: (id, text) in order. Texts without lines that match an earlier line."""
    seen, out = [], []
    for _, text in docs:
        if text is None:
            out.append(None)
            continue
        keep = []
        for line in text.split("\n"):
            own = set(line.lower().split())
            if own:
                gone = any(5 * len(own & s) >= 4 * len(own | s) for s in seen)
                seen.append(own)
                if gone:
                    continue
            keep.append(line)
        out.append("\n".join(keep))
    return out


def shingle_set(text, n=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts):
    """The position of the first member of each text's component."""
    sets = [shingle_set(t) for t in texts]
    first = list(range(len(sets)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                first[y] = x
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def katz(rows, discounts, k=5):
    """(scores, base scores, N) of (doc_id, text) rows."""
    end, start = b"\n", b" "
    texts = [[*(t or "").encode().lower().split(), end] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    c, pairs, hist = Counter(), Counter(), Counter()
    for words, h in zip(texts, held, strict=True):
        if not h:
            before = [start, *words[:-1]]
            c.update(words)
            pairs.update(zip(before, words, strict=True))
            hist.update(before)
    n = sum(c.values())
    of = lambda counts: [0, *[sum(v == r for v in counts.values()) for r in range(1, k + 2)]]
    d1, d2 = discounts(of(c)), discounts(of(pairs))
    p = {w: (d1[r] if r <= k else 1) * r / n for w, r in c.items()}
    unseen = 1 - sum(p.values()) if n else 1.0
    followers = defaultdict(list)
    for (u, v), r in pairs.items():
        followers[u].append((v, r))
    total = lambda u: hist[u] + (hist[u] > k)
    cond = lambda u, r: (d2[r] if r <= k else 1) * r / total(u)
    alpha = {u: (1 - sum(cond(u, r) for _, r in f)) / (1 - sum(p[v] for v, _ in f)) for u, f in followers.items()}
    score = [sum(math.log10(cond(u, pairs[u, w]) if pairs[u, w] else alpha.get(u, 1.0) * p.get(w, unseen)) for u, w in zip([start, *x[:-1]], x, strict=True)) for x in texts]
    base = [sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in x) for x in texts]
    sums = {u: sum(cond(u, r) for _, r in f) + alpha[u] * (1 - sum(p[v] for v, _ in f)) for u, f in followers.items()}
    return score, base, n, sums
