"""Well-known bytes decoded a batch at a time.

All geometries of a batch advance together: each step reads one ring (a lone
position, a line or a polygon's ring) of every geometry that still has one, so
the number of steps is that of the rings of the batch's largest geometry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINT, POLYGON, MULTIPOINT, MULTIPOLYGON = 1, 3, 4, 6


def _numbers(data: np.ndarray, at: np.ndarray, big: np.ndarray, form: str) -> np.ndarray:
    """The numbers that begin at the places ``at``, in either byte order."""
    width = np.dtype(form).itemsize
    raw = np.ascontiguousarray(data[at[:, None] + np.arange(width)])
    raw[big] = raw[big, ::-1]
    return raw.view(f"<{form}").reshape(len(at))


def _rings(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Geometry, whether a polygon and a ring begin, place, positions and byte order of each ring, in the order of the geometries; and each geometry's code."""
    n = len(start)
    big, code = data[start] == 0, np.zeros(n, np.int64)
    code[:] = _numbers(data, start + 1, big, "u4") & 0xFF
    if n and not np.isin(code, np.arange(1, 7)).all():
        raise ValueError("unknown kind of geometry")
    at, many = start.copy(), code >= MULTIPOINT
    parts = np.ones(n, np.int64)
    parts[many] = _numbers(data, start[many] + 5, big[many], "u4")
    at[many] += 9
    rings, kind, order, fresh = np.zeros(n, np.int64), code.copy(), big.copy(), np.ones(n, bool)
    found, step = [], 0
    live = np.flatnonzero(parts > 0)
    while len(live):
        head = live[rings[live] == 0]  # these begin a part, with its own header
        order[head] = data[at[head]] == 0
        kind[head] = _numbers(data, at[head] + 1, order[head], "u4") & 0xFF
        at[head] += 5
        parts[head] -= 1
        rings[head] = 1
        areas = head[kind[head] == POLYGON]
        rings[areas] = _numbers(data, at[areas], order[areas], "u4")
        at[areas] += 4
        begins = np.zeros(n, bool)
        begins[head] = fresh[head] | (code[head] == MULTIPOLYGON)
        empty = live[rings[live] == 0]  # a polygon without rings
        has = live[rings[live] > 0]
        size = np.ones(len(has), np.int64)
        counted = kind[has] != POINT
        size[counted] = _numbers(data, at[has[counted]], order[has[counted]], "u4")
        at[has[counted]] += 4
        opens = fresh[has] | (code[has] != MULTIPOINT)
        found.append((has, np.full(len(has), step), begins[has], opens, at[has].copy(), size, order[has].copy()))
        found.append((empty, np.full(len(empty), step), begins[empty], np.zeros(len(empty), bool), at[empty].copy(), np.zeros(len(empty), np.int64), order[empty].copy()))
        at[has] += 16 * size
        rings[has] -= 1
        fresh[live] = False
        step += 1
        live = live[(rings[live] > 0) | (parts[live] > 0)]
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)] * 2 + [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)]
    along = np.lexsort((columns[1], columns[0]))
    geometry, _, begins, opens, place, size, order = (c[along] for c in columns)
    return geometry, begins, opens, place, size, order, code


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def decode(column: pa.Array) -> pa.Array:
    """Depth-4 coordinates of a column of well-known bytes; null for null, no polygons for a collection without parts. Only x and y are read."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    known = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    geometry, begins, opens, place, size, order, code = _rings(data, offsets[:-1][known].astype(np.int64))
    n = len(code)
    polygon = np.cumsum(begins) - 1  # of each ring
    ring = np.cumsum(opens) - 1
    polygons, rings = int(begins.sum()), int(opens.sum())
    # positions of all rings, one after another
    first = np.cumsum(size) - size
    at = np.repeat(place, size) + 16 * (np.arange(int(size.sum())) - np.repeat(first, size))
    big = np.repeat(order, size)
    xy = np.column_stack([_numbers(data, at, big, "f8"), _numbers(data, at + 8, big, "f8")]).reshape(-1)
    positions = pa.ListArray.from_arrays(_offsets(np.full(len(at), 2)), pa.array(xy))
    held = np.bincount(ring[size > 0], weights=size[size > 0], minlength=rings).astype(np.int64) if rings else np.zeros(0, np.int64)
    lines = pa.ListArray.from_arrays(_offsets(held), positions)
    areas = pa.ListArray.from_arrays(_offsets(np.bincount(polygon[opens], minlength=polygons)), lines)
    counts = np.zeros(len(column), np.int64)
    counts[known] = np.bincount(geometry[begins], minlength=n)
    return pa.ListArray.from_arrays(_offsets(counts), areas, mask=pa.array(~known))
