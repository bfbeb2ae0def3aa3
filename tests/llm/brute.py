"""Plain-Python counterparts of the operators, for small inputs."""

import re
import zlib
from collections import defaultdict


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def components(docs):
    """{doc_id: (set size, component)} of (doc_id, text) rows."""
    sets = {d: shingle_set(t) for d, t in docs}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        for other in set().union(*(by[x] for x in s)) if s else ():
            if other > d and 100 * len(s & sets[other]) >= 75 * len(s | sets[other]):
                a, b = sorted((find(d), find(other)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
