"""Polygons as cells of a quadtree, so that a point is tested against a few edges.

A cell of level l is the world's width (360) halved l times. Each cell keeps
the edges that touch it. Of the others only those to its right matter to the
even-odd rule: such an edge counts for the latitudes from its lower end up to
its upper one, so all of them together are the latitudes where their parity
changes. Ends that meet cancel, which leaves few: ``base`` is the parity below
the cell, ``turns`` are the changes within it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import crosses, on_edge

#: Finest level of cells.
FINEST = 20
#: Edges that a cell may have.
MOST = 32
_EDGE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])
_PLACE = [T.StructField("level", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("base", T.IntegerType())]
CELLS = T.ArrayType(T.StructType(_PLACE + [T.StructField("turns", T.ArrayType(T.DoubleType())), T.StructField("edges", T.ArrayType(_EDGE))]))
#: Cells are this much wider when edges are dealt to them, beyond any rounding of a point's cell.
_PAD = 1e-9


def _turns(values: np.ndarray, low: float, high: float) -> tuple[int, np.ndarray]:
    """Parity of the values below ``low``, and those up to ``high`` that occur an odd number of times."""
    ends, n = np.unique(values[(values >= low) & (values <= high)], return_counts=True)
    return int(np.count_nonzero(values < low) % 2), ends[n % 2 == 1]


def _deal(edges: np.ndarray, cell: tuple, base: int, turns: np.ndarray) -> tuple:
    """Of a parent's edges those that touch a cell; the ends of those to its right join the turns."""
    level, cx, cy = cell
    side = 360.0 / (1 << level)
    w, s, e, n = cx * side - _PAD, cy * side - _PAD, (cx + 1) * side + _PAD, (cy + 1) * side + _PAD
    x1, y1, x2, y2 = edges.T
    across = (np.minimum(y1, y2) <= n) & (np.maximum(y1, y2) >= s)
    left, right = np.maximum(x1, x2) < w, np.minimum(x1, x2) > e
    # corners of the cell all to one side of an edge's line: it passes by
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (w, e) for y in (s, n)]
    margin = 1e-12 * (1 + np.abs(x2 - x1) + np.abs(y2 - y1))
    up = y2 > y1
    above, below = np.min(sides, axis=0) > margin, np.max(sides, axis=0) < -margin
    right |= ~left & np.where(up, above, below)
    left |= ~right & np.where(up, below, above)
    beyond = edges[across & right]
    odd, turns = _turns(np.concatenate([turns, beyond[:, 1], beyond[:, 3]]), s, n)
    return edges[across & ~left & ~right], (base + odd) % 2, turns


def cover(edges: np.ndarray, most: int = MOST, finest: int = FINEST) -> list[tuple]:
    """Cells ``(level, x, y, base, turns, edges)`` that hold all of a polygon, none within another.

    The cell with the most edges is cut in four until none has more than
    ``most`` or there are as many cells as a quarter of the edges, 64 at least.
    """
    edges = edges[~np.isnan(edges).any(axis=1)]
    if not len(edges):
        return []
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    size = max(np.ptp(xs), np.ptp(ys))
    level = finest if size <= 360.0 / (1 << finest) else max(0, int(np.floor(np.log2(360.0 / size))))

    def at(v: float) -> int:
        return int(np.floor(v * (1 << level) / 360.0))

    queue, done, n = [], [], 0

    def add(parent: np.ndarray, cell: tuple, base: int, turns: np.ndarray) -> None:
        nonlocal n
        mine, base, turns = _deal(parent, cell, base, turns)
        if len(mine) > most and cell[0] < finest:
            n += 1
            heapq.heappush(queue, (-len(mine), n, cell, base, turns, mine))
        elif len(mine) or len(turns) or base:
            done.append((*cell, base, turns, mine))

    for x in range(at(xs.min()), at(xs.max()) + 1):
        for y in range(at(ys.min()), at(ys.max()) + 1):
            add(edges, (level, x, y), 0, np.empty(0))
    budget = max(64, len(edges) // 4)
    while queue and len(queue) + len(done) < budget:
        _, _, (lv, x, y), base, turns, mine = heapq.heappop(queue)
        for cell in ((lv + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)):
            add(mine, cell, base, turns)
    return done + [(*cell, base, turns, mine) for _, _, cell, base, turns, mine in queue]


@F.pandas_udf(CELLS)
def _cover(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    names = ("level", "x", "y", "base", "turns")

    def of(columns) -> list[dict] | None:
        if columns[0] is None:
            return None
        out = []
        for *head, edges in cover(np.column_stack([np.asarray(c, dtype=float) for c in columns])):
            out.append(dict(zip(names, head)) | {"edges": [dict(zip(("x1", "y1", "x2", "y2"), e)) for e in edges.tolist()]})
        return out

    return pd.Series([of(c) for c in zip(x1, y1, x2, y2)])


def cover_cells(edges: Column) -> Column:
    """The cells of a polygon given by its segments, see :func:`cover`; null for null."""
    return _cover(edges["x1"], edges["y1"], edges["x2"], edges["y2"])


def in_cell(x: Column, y: Column, cell: Column) -> Column:
    """Whether a position within a cell is inside of, or on, the cell's polygon."""
    near = cell["edges"]
    turned = F.size(F.filter(cell["turns"], lambda t: t <= y))
    crossed = F.size(F.filter(near, lambda e: crosses(e, x, y)))
    exact = ((cell["base"] + turned + crossed) % 2 == 1) | F.exists(near, lambda e: on_edge(e, x, y))
    inner = (F.size(near) == 0) & (F.size(cell["turns"]) == 0)
    return F.when(inner, cell["base"] == 1).otherwise(exact)
