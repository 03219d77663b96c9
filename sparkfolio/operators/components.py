"""Groups of touching rows within keys: by a fold over the edges of a small key's array, by a search over cells of a page for many boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far boxes may lie apart, and what share of the narrower must lie across; cells a side of a page at most.
GAP, ACROSS, CELLS = 0.02, 0.25, 256


def components_of(edges: Column, ids: Column) -> Column:
    """For each of ``ids`` the least id that it reaches by ``edges`` (array<struct<u, v>>): each edge, in order, unites the sets of its ends."""
    def unite(s, x):
        of = lambda n: F.filter(s, lambda r: r["id"] == n)[0]["c"]
        both = F.array(F.struct(F.least(of(x["u"]), of(x["v"])).alias("low"), F.greatest(of(x["u"]), of(x["v"])).alias("high")))
        return F.flatten(F.transform(both, lambda b: F.transform(s, lambda r: F.struct(r["id"].alias("id"), F.when(r["c"] == b["high"], b["low"]).otherwise(r["c"]).alias("c")))))

    start = F.transform(ids, lambda i: F.struct(i.alias("id"), i.alias("c")))
    return F.transform(F.aggregate(edges, start, unite), lambda r: r["c"])


def touching_groups(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each box the least place in its group; boxes touch across ACROSS of the narrower one and at most GAP apart downwards.

    Boxes meet in cells about four of them wide and high, each in all that it reaches into. In a cell a search goes from box to box over those not reached yet, so boxes that lie
    in heaps are reached in a few steps, and each adds one link; links of all cells unite the groups.
    """
    n = len(x)
    right, bottom, group = x + w, y + h, np.arange(n)

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def cells(low, high):
        width = max(4 * float(np.mean(high - low)), float(high.max() - low.min()) / CELLS, 1e-9)
        return ((low - low.min()) // width).astype(np.int64), ((high - low.min()) // width).astype(np.int64)

    (left_cell, right_cell), (top_cell, low_cell) = cells(x, right), cells(y, bottom + GAP)
    wide, high = right_cell - left_cell + 1, low_cell - top_cell + 1
    times = wide * high
    box = np.repeat(np.arange(n), times)
    at = np.arange(len(box)) - np.repeat(np.cumsum(times) - times, times)
    key = (top_cell[box] + at // wide[box]) * (int(right_cell.max()) + 1) + left_cell[box] + at % wide[box]
    order = np.argsort(key, kind="stable")
    box, edges = box[order], np.flatnonzero(np.diff(key[order])) + 1
    for held in np.split(box, edges):
        waiting = held
        while len(waiting):
            queue, waiting = [waiting[0]], waiting[1:]
            while queue and len(waiting):
                b = queue.pop()
                across = np.minimum(right[b], right[waiting]) - np.maximum(x[b], x[waiting])
                apart = np.maximum(y[b], y[waiting]) - np.minimum(bottom[b], bottom[waiting])
                near = (across >= ACROSS * np.minimum(w[b], w[waiting])) & (apart <= GAP)
                found, waiting = waiting[near], waiting[~near]
                for f in found:
                    one, other = root(b), root(f)
                    group[max(one, other)] = min(one, other)
                queue.extend(found)
    return np.array([root(i) for i in range(n)], np.int64)
