"""Brute-force versions of the operators."""

import numpy as np


def word_sets(rows, k):
    """Distinct word shingles of (id, text) rows."""
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    return out


class Groups:
    def __init__(self, nodes):
        self.root = {n: n for n in nodes}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)


def jaccard_groups(rows, percent, k):
    sets = word_sets(rows, k)
    groups = Groups(i for i, _ in rows if i is not None)
    linkable = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, x) in enumerate(linkable):
        for j, y in linkable[:a]:
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    groups.join(i, j)
    return sorted(((i, len(s), None if i is None else groups.find(i)) for i, s in sets), key=str)


def cosine_groups(rows, least):
    """(id, links, component) of usable vectors given as (id, list)."""
    def good(i, v):
        return i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, float)) for i, v in rows if good(i, v)]
    unit = [v / np.abs(v).max() for _, v in ok]
    unit = [v / np.linalg.norm(v) for v in unit]
    groups, links = Groups(i for i, _ in ok), [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                groups.join(ok[a][0], ok[b][0])
    return sorted((i, n, groups.find(i)) for (i, _), n in zip(ok, links))


def top_k(rows, k):
    """(query, rank, id, score) for queries with an id divisible by 20."""
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)
