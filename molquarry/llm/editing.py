"""Bounded edit distance of many pairs of strings at once, in numpy."""

from __future__ import annotations

import numpy as np

#: entries of one padded block of characters
BLOCK = 4_000_000


def code_matrix(values: list[str], width: int, lead: int = 0, fill: int = 0) -> np.ndarray:
    size = np.fromiter(map(len, values), np.int64, len(values))
    out = np.full((len(values), width), fill, np.uint32)
    column = np.arange(width)[None, :]
    inside = (column >= lead) & (column < lead + size[:, None])
    out[inside] = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    return out


def within(left: list[str], right: list[str], limit: int) -> np.ndarray:
    """Whether at most `limit` inserted, deleted or replaced characters separate left[i] from right[i]."""
    out = np.zeros(len(left), bool)
    a = np.fromiter(map(len, left), np.int64, len(left))
    b = np.fromiter(map(len, right), np.int64, len(right))
    order = np.flatnonzero(np.abs(a - b) <= limit)
    order = order[np.argsort(a[order], kind="stable")]
    at = 0
    while at < len(order):
        # rows of like length share a block
        step, longest = 0, 0
        while at + step < len(order) and (step == 0 or (step + 1) * (a[order[at + step]] + 1) <= BLOCK):
            longest = int(a[order[at + step]])
            step += 1
        part = order[at : at + step]
        out[part] = _banded([left[i] for i in part], [right[i] for i in part], a[part], b[part], longest, limit)
        at += step
    return out


def _banded(left: list[str], right: list[str], a: np.ndarray, b: np.ndarray, longest: int, limit: int) -> np.ndarray:
    """The band |i - j| <= limit of the distance table, one row of all pairs at a time."""
    band = 2 * limit + 1
    rows = code_matrix(left, longest, fill=0xFFFFFFFE)
    columns = code_matrix(right, longest + band, lead=limit, fill=0xFFFFFFFF)
    over = limit + 1
    step = np.arange(band, dtype=np.int16)
    state = np.broadcast_to(np.where(step >= limit, step - limit, over), (len(left), band)).astype(np.int16)
    out = np.zeros(len(left), bool)
    live = np.arange(len(left))
    for i in range(longest + 1):
        ends = a[live] == i
        if ends.any():
            k = np.flatnonzero(ends)
            out[live[k]] = state[k, (b[live[k]] - i + limit)] <= limit
            go = ~ends & (state.min(axis=1) <= limit)
            live, state = live[go], state[go]
            rows, columns = rows[go], columns[go]
        elif i % 8 == 7:
            go = state.min(axis=1) <= limit
            if not go.all():
                live, state, rows, columns = live[go], state[go], rows[go], columns[go]
        if not len(live):
            break
        # diagonal d of row i is column i + d - limit; columns are shifted by limit
        swap = state + (columns[:, i : i + band] != rows[:, i, None])
        swap[:, :-1] = np.minimum(swap[:, :-1], state[:, 1:] + 1)
        # columns before the first can't be reached, except column 0 by deletions
        outside = limit - (i + 1)
        if outside > 0:
            swap[:, :outside] = over
        if 0 <= outside < band:
            swap[:, outside] = np.minimum(over, i + 1)
        swap = np.minimum.accumulate(swap - step, axis=1) + step
        state = np.minimum(swap, over).astype(np.int16)
    return out
