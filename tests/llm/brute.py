"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=4):
    w = words(lowered(text or ""))
    if not w:
        return frozenset()
    return frozenset(zip(*[w[i:] for i in range(width)])) if len(w) >= width else frozenset([tuple(w)])


def components(ids, sets, num=85, den=100):
    """Smallest id that each row reaches by links; rows with empty sets are alone."""
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                common = len(a & b)
                if den * common >= num * (len(a) + len(b) - common):
                    parent[find(i)] = find(j)
    lowest = {}
    for i, value in enumerate(ids):
        root = find(i)
        if value is not None:
            lowest[root] = min(lowest.get(root, value), value)
    return [lowest.get(find(i)) if sets[i] else ids[i] for i in range(len(ids))]


def crc(text):
    return zlib.crc32((text or "").encode())
