"""Brute force that several tests share."""

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components_of(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}
