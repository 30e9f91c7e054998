"""Plain versions of the operators, for small tables."""

import re
from itertools import combinations


def shingle_set(text, width=5):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(texts):
    """texts: {doc: text} -> {doc: (n_shingles, component)}"""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if 100 * len(sets[a]) < 75 * len(sets[b]):
                break
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


__all__ = ["combinations", "components", "shingle_set"]
