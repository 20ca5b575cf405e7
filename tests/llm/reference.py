"""Plain versions of the operators, for comparison on small inputs."""

import re
import unicodedata
from itertools import combinations

MISSING = ("", "NA", "nan", "ValueNotFound")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def classes(values, linked):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(sorted(values), 2):
        if find(a) != find(b) and linked(a, b):
            parent[find(b)] = find(a)
    return {v: find(v) for v in values}


def near(a, b):
    return abs(len(a) - len(b)) <= 4 and edit_distance(a, b) <= 4


def alike(a, b):
    x, y = ({v[i : i + 3] for i in range(len(v) - 2)} for v in (a, b))
    return bool(x | y) and 3 * len(x & y) >= len(x | y)


def markov_flow(values, inflation=2, rounds=60):
    """What flows into each value in the limit of Markov clustering of all similar values, unpruned."""
    import numpy as np

    sets = [{v[i : i + 3] for i in range(len(v) - 2)} for v in values]
    m = np.array([[len(x & y) / len(x | y) if alike(a, b) else 0.0 for b, y in zip(values, sets)] for a, x in zip(values, sets)])
    np.fill_diagonal(m, 1)
    m /= m.sum(axis=0)
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m /= m.sum(axis=0)
    return dict(zip(values, m.sum(axis=1).tolist()))


def value(v):
    v = v.strip(" \t") if v is not None else None
    return None if v is None or v in MISSING else v


def classed(rows, fields, linked):
    """rows: dicts; a tuple of classes for each, None where a field is missing."""
    by = {f: classes({value(r[f]) for r in rows} - {None}, linked) for f in fields}
    out = []
    for r in rows:
        key = tuple(by[f].get(value(r[f])) for f in fields)
        out.append(None if None in key else key)
    return out


def split(v):
    return v.strip(" \t").lower() if v is not None else None


def quality(text, words):
    lines = [x.strip(" \t\r") for x in (text or "").split("\n")]
    lines = [x for x in lines if x and not all(c in "0123456789" for c in x) and "-->" not in x]
    tokens = [w for x in lines for w in re.split("[ \t\r\n]+", x) if w]
    chars = "".join(tokens)
    letter = lambda c: unicodedata.category(c)[0] == "L"
    symbols = sum(not (letter(c) or c in "0123456789") for c in chars)

    def bare(w):
        w = w.lower()
        while w and not letter(w[0]):
            w = w[1:]
        while w and not letter(w[-1]):
            w = w[:-1]
        return w

    common = sum(bare(w) in words for w in tokens)
    ended = sum(x[-1] in ".!?…" for x in lines)
    signs = 0
    if tokens:
        mean = len(chars) / len(tokens)
        signs = (symbols / len(chars) > 0.22) + (common / len(tokens) < 0.15) + (ended / len(lines) < 0.25) + (mean < 2.8 or mean > 8.0)
    return len(lines), len(tokens), len(chars), symbols, common, ended, len(tokens) >= 5 and signs >= 2
