"""Points in polygons by cells: against all edges, on borders, in hot places."""

import numpy as np
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.cover import cover
from geoloom.operators import joins


def ring(rng, n, x, y, r):
    """A star-shaped ring of n corners on a grid of hundredths."""
    angle, length = np.sort(rng.random(n)) * 2 * np.pi, r * (0.3 + 0.7 * rng.random(n))
    p = np.round(np.column_stack([x + length * np.cos(angle), y + length * np.sin(angle)]), 2)
    return np.vstack([p, p[:1]])


def parity(x, y, edges):
    x1, y1, x2, y2 = edges.T
    side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    crossed = ((y1 > y) != (y2 > y)) & ((side > 0) == (y2 > y1))
    on = (side == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
    return int(np.count_nonzero(crossed)), bool(on.any())


def test_cells_tell_what_all_edges_tell():
    rng = np.random.default_rng(1)
    for n, most in ((3, 1), (60, 2), (900, 8)):
        rings = [ring(rng, n, 10, 20, 9), ring(rng, n, 12, 21, 5)]  # where both are is outside
        edges = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
        cells = {c[:3]: c[3:] for c in cover(edges, most)}
        levels = {k[0] for k in cells}
        spots = np.vstack([np.round(rng.random((400, 2)) * 20 + [0, 10], 2), edges[:100, :2]])
        for x, y in spots:
            at = [(k, int(np.floor(x * 2.0**k / 360)), int(np.floor(y * 2.0**k / 360))) for k in levels]
            mine = [cells[k] for k in at if k in cells]
            crossed, on = parity(x, y, edges)
            assert len(mine) <= 1
            base, turns, near = mine[0] if mine else (0, np.empty(0), np.empty((0, 4)))
            c, o = parity(x, y, near)
            assert ((base + np.count_nonzero(turns <= y) + c) % 2 == 1 or o) == (crossed % 2 == 1 or on)


def test_a_large_polygon_is_few_edges_a_cell():
    angle = np.linspace(0, 2 * np.pi, 100_001)
    p = np.column_stack([80 + 9 * np.cos(angle), 20 + 9 * np.sin(angle) * (1 + 0.1 * np.sin(40 * angle))])
    cells = cover(np.hstack([p[:-1], p[1:]]))
    assert max(len(c[5]) for c in cells) <= 32 and sum(len(c[5]) for c in cells) < 130_000
    assert any(not len(c[5]) and not len(c[4]) and c[3] for c in cells)  # inner cells
    assert not cover(np.empty((0, 4))) and not cover(np.full((3, 4), np.nan))


def _points(spark, rows):
    df = spark.createDataFrame(rows, "id int, lon double, lat double").withColumn("geom_type", F.lit("Point"))
    df = df.withColumn("coords", F.when(F.col("lon").isNotNull(), G.point_coords(F.col("lon"), F.col("lat"))))
    return df.withColumn("bbox", F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax")))


def _polygons(spark, rings):
    rows = [(i, [[r.tolist()]]) for i, r in enumerate(rings)]
    df = spark.createDataFrame(rows, f"polygon_id int, coords {G.COORDS}").withColumn("geom_type", F.lit("Polygon"))
    return df.withColumn("bbox", G.bbox(F.col("coords"))).withColumn("edges", G.edges(F.col("coords")))


def test_join_of_points_in_a_hot_place(spark):
    """A third of all points in one city, most of them at one spot; a polygon of the world's size, large ones and small ones."""
    rng = np.random.default_rng(3)
    world = np.array([[-179.5, -85.5], [179.5, -85.5], [179.5, 85.5], [-179.5, 85.5], [-179.5, -85.5]])
    rings = [world] + [ring(rng, n, x, y, r) for n, x, y, r in ((300, 77, 12, 8), (40, 77.1, 12.1, 0.5), (5, 77, 12, 0.02), (200, -60, -20, 15))]
    spots = [(77.01, 12.01)] * 150 + [(77 + x, 12 + y) for x, y in np.round(rng.random((150, 2)) / 10, 3)] + [tuple(p) for p in np.round(rng.random((600, 2)) * [360, 170] - [180, 85], 2)]
    spots += [tuple(p) for p in rings[1][:50]] + [(None, None)]
    rows = [(i, *map(lambda v: None if v is None else float(v), p)) for i, p in enumerate(spots)]
    want = []
    for j, r in enumerate(rings):
        edges = np.hstack([r[:-1], r[1:]])
        for i, x, y in rows:
            if x is not None:
                crossed, on = parity(x, y, edges)
                if crossed % 2 == 1 or on:
                    want.append((i, j))
    points, polygons = _points(spark, rows), _polygons(spark, rings)
    for hot, small in ((20, 0), (1_000_000, 0), (1_000_000, 10 * 1024**2)):
        got = [(r["id"], r["polygon_id"]) for r in joins.spatial_join(points, polygons, hot=hot, small=small).collect()]
        assert sorted(got) == sorted(want)
    semi = joins.spatial_join(points, polygons, how="left_semi", hot=20, small=0)
    assert sorted(r["id"] for r in semi.collect()) == sorted({i for i, _ in want})
    keyed, cells = points.withColumn("_cell", F.struct(F.lit(False).alias("whole"), F.lit(0).alias("level"), F.lit(0).alias("x"), F.lit(0).alias("y"))), None
    cells = keyed.select("_cell").distinct()
    salted, copied = joins._salted(keyed, cells, 100)
    sizes = sorted(r["count"] for r in salted.groupBy("_cell", "_salt").count().collect())
    assert copied.count() == len(sizes) == 10 and sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_join_of_empty_tables(spark):
    points, polygons = _points(spark, []), _polygons(spark, [])
    assert joins.spatial_join(points, polygons).count() == 0
    assert joins.spatial_join(_points(spark, [(1, 77.0, 12.0)]), polygons).count() == 0
