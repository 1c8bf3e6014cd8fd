"""Brute-force versions that tests compare with."""

import collections
import itertools


def near_classes(rows, least=0.8, k=5):
    """Smallest doc_id of each document's component, over all pairs that share a shingle."""
    shingles = []
    for _, t in rows:
        w = (t or "").encode().split()
        shingles.append(collections.Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else collections.Counter())
    places = collections.defaultdict(set)
    for i, s in enumerate(shingles):
        for e in s:
            places[e].add(i)
    shared = collections.Counter(p for v in places.values() for p in itertools.combinations(sorted(v), 2))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in shared.items():
        a, b = shingles[i], shingles[j]
        every = set(a) | set(b)
        if n < 0.5 * len(every) or find(i) == find(j):
            continue
        if max(a.values()) == max(b.values()) == 1:
            s = n / len(every)
        else:
            s = sum(1 / sum(max(a.get(f, 0) / a[e], b.get(f, 0) / b[e]) for f in every) for e in set(a) & set(b))
        if s >= least - 1e-9:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least_id = {}
    for i, (d, _) in enumerate(rows):
        least_id[find(i)] = min(least_id.get(find(i), d), d)
    return {d: least_id[find(i)] for i, (d, _) in enumerate(rows)}


def removed_words(rows, n=50):
    """(doc_id, words kept, number of words) of each row."""
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    for d, w in words:
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        yield d, [x for j, x in enumerate(w) if j not in gone], len(w)
