"""Exact Jaccard components by prefix filtering and plain sets."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components(docs, k=4, percent=85):
    """docs: {id: text} -> {id: (set size, least id of the component)}."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    classes = {}
    for i in sorted(sets):
        classes.setdefault(sets[i] or i, i)
    reps = {i: s for s, i in classes.items() if s != i}
    df = Counter(x for s in reps.values() for x in s)
    up = {i: i for i in reps}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    index = defaultdict(list)
    for i, s in reps.items():
        near = set()
        for x in sorted(s, key=lambda x: (df[x], x))[:len(s) - math.ceil(percent * len(s) / 100) + 1]:
            if df[x] > 1:
                near.update(index[x])
                index[x].append(i)
        for j in near:
            a, b = len(s), len(reps[j])
            if find(i) != find(j) and percent * max(a, b) <= 100 * min(a, b):
                both = len(s & reps[j])
                if 100 * both >= percent * (a + b - both):
                    up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in reps:
        least[find(i)] = min(least.get(find(i), i), i)
    return {i: (len(s), least[find(classes[s])] if s else i) for i, s in sets.items()}
