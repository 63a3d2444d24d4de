"""A space-filling curve as a Column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def curve(box: Column, bits: int = 16) -> Column:
    """Place of a box's centre, in degrees, on a Hilbert curve over the world of 2**bits cells a side.

    From the highest bit down a cell's quarter adds its number on the curve, and
    the lower bits are turned and mirrored as the curve runs in that quarter.
    """
    side = 1 << bits

    def scaled(low: str, high: str, least: float, width: float) -> Column:
        v = ((box[low] + box[high]) / 2 - least) / width * side
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(v))).cast("bigint")

    start = F.struct(scaled("xmin", "xmax", -180.0, 360.0).alias("x"), scaled("ymin", "ymax", -90.0, 180.0).alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(a: Column, k: Column) -> Column:
        half = F.expr("1L") * F.pow(F.lit(2.0), k).cast("bigint")
        x, y = a["x"], a["y"]
        right, up = (x >= half).cast("bigint"), (y >= half).cast("bigint")
        d = a["d"] * 4 + F.when(right == 1, 3 - up).otherwise(up)
        # within the quarter
        x, y = x - right * half, y - up * half
        mirrored = (up == 0) & (right == 1)
        turned = up == 0
        mx, my = F.when(mirrored, half - 1 - x).otherwise(x), F.when(mirrored, half - 1 - y).otherwise(y)
        return F.struct(F.when(turned, my).otherwise(mx).alias("x"), F.when(turned, mx).otherwise(my).alias("y"), d.alias("d"))

    return F.aggregate(F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)]), start, step, lambda a: a["d"])


def curve_places(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """The same for the centres ``x, y`` of a batch of rows; missing ones come first."""
    side, out = 1 << bits, np.zeros(len(x), np.int64)
    known = ~(np.isnan(x) | np.isnan(y))

    def scaled(v: np.ndarray, least: float, width: float) -> np.ndarray:
        return np.clip(np.floor((v[known] - least) / width * side), 0, side - 1).astype(np.int64)

    x, y, d = scaled(x, -180.0, 360.0), scaled(y, -90.0, 180.0), out[known]
    for k in range(bits - 1, -1, -1):
        half = 1 << k
        right, up = x >= half, y >= half
        d = d * 4 + np.where(right, 3 - up, up)
        x, y = x - right * half, y - up * half
        mirrored = right & ~up
        mx, my = np.where(mirrored, half - 1 - x, x), np.where(mirrored, half - 1 - y, y)
        x, y = np.where(up, mx, my), np.where(up, my, mx)
    out[known] = d
    out[~known] = -1
    return out
