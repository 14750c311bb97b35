"""Plain versions of the contracts, one text at a time."""

import re
import zlib
from collections import Counter
from itertools import combinations

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, lower=False, pattern=WORD):
    data = (text or "").encode()
    return [w.decode() for w in pattern.findall(data.translate(LOW) if lower else data)]


def shingle_set(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """doc_id -> (size, component) over all pairs."""
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_rules(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x.encode())]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    covered = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def contamination(text, items):
    w = words(text, True, PLAIN)
    hit, names = set(), []
    for item, t in items:
        x = words(t, True, PLAIN)
        if not x:
            continue
        n = min(13, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        found = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
        if found:
            names.append(str(item))
            hit |= {p for i in found for p in range(i, i + n)}
    return len(w), len(hit), len(names), ",".join(sorted(names))


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n
