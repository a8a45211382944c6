"""Plain Python statements of the contracts, and small awkward tables."""

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")

#: ids out of order, null id and texts, repeated rows, blank and long texts
AWKWARD = [
    (7, "Alpha beta\ngamma"), (3, None), (None, "alpha beta\ngamma"), (9, ""), (5, "ALPHA BETA\nGAMMA"),
    (5, "ALPHA BETA\nGAMMA"), (11, " \t \n\n"), (12, "Été É é ß 中文 🙂"), (13, "x" * 70_000), (14, "word " * 30_000), (15, None),
]


def ascii_lower(text):
    return text.translate(LOWER)


def shingles(text, size):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else zip(*(words[i:] for i in range(size))))


def components(texts, size, num, den):
    """id -> (set size, smallest linked id), all pairs by an inverted index."""
    sets = {d: shingles(t, size) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(o for s in sets[d] for o in holds[s])
        for o, n in shared.items():
            if den * n >= num * (len(sets[d]) + len(sets[o]) - n):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holds[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def drop_lines(texts, min_docs):
    """id -> (lines, dropped, text left)."""
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    lines = {d: (t or "").split("\n") for d, t in texts.items()}
    found = Counter(k for ls in lines.values() for k in {key(x) for x in ls} if k)
    out = {}
    for d, ls in lines.items():
        left = [x for x in ls if found[key(x)] < min_docs or not key(x)]
        out[d] = (len(ls), len(ls) - len(left), "\n".join(left))
    return out


def edit_substring(item, text):
    """The smallest edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)
