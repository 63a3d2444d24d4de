"""Geometry as nested arrays, and exact tests as Column expressions.

Every geometry in flight is an array of polygons of rings of ``[x, y, ...]``
(depth 4); points and lines are wrapped to the same depth. Rings follow the
even-odd rule, touching counts as intersecting.
"""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wkb import decode

COORDS = "array<array<array<array<double>>>>"
COORDS_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
#: Levels of array around a position in each type's coordinates.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
TYPE_CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}


def coords_from_json(geometry: Column) -> Column:
    """Depth-4 coordinates of GeoJSON geometry text; null where there are none."""
    kind = F.get_json_object(geometry, "$.type")
    raw = F.get_json_object(geometry, "$.coordinates")
    out = F.lit(None).cast(COORDS)
    for name, depth in DEPTH.items():
        wrapped = F.concat(F.lit("[" * (3 - depth)), raw, F.lit("]" * (3 - depth)))
        out = F.when(kind == name, F.from_json(wrapped, COORDS)).otherwise(out)
    return out


def point_coords(lon: Column, lat: Column) -> Column:
    return F.array(F.array(F.array(F.array(lon, lat))))


def vertices(coords: Column) -> Column:
    """All positions of a depth-4 geometry."""
    return F.flatten(F.flatten(coords))


def bbox(coords: Column) -> Column:
    v = vertices(coords)
    x, y = F.transform(v, lambda p: F.get(p, 0)), F.transform(v, lambda p: F.get(p, 1))
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def edges(coords: Column) -> Column:
    """Segments ``struct(x1, y1, x2, y2)`` of all rings; a lone position is a segment of no length."""

    def of(ring: Column) -> Column:
        def segment(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, i + 1)
            return F.struct(F.get(a, 0).alias("x1"), F.get(a, 1).alias("y1"), F.get(b, 0).alias("x2"), F.get(b, 1).alias("y2"))

        p = F.get(ring, 0)
        dot = F.struct(F.get(p, 0).alias("x1"), F.get(p, 1).alias("y1"), F.get(p, 0).alias("x2"), F.get(p, 1).alias("y2"))
        return F.when(F.size(ring) >= 2, F.transform(F.sequence(F.lit(0), F.size(ring) - 2), segment)).when(F.size(ring) == 1, F.array(dot)).otherwise(F.array())

    return F.flatten(F.transform(F.flatten(coords), of))


def polygon_edges(rings: list[list[tuple[float, float]]]) -> Column:
    """A polygon given in Python as a literal array of segments."""
    out = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            out.append(F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))]))
    return F.array(*out)


def _side(e: Column, x: Column, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def on_edge(e: Column, x: Column, y: Column) -> Column:
    within = (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"])) & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"]))
    return within & (_side(e, x, y) == 0)


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether a segment crosses the ray from a position to its right."""
    return ((e["y1"] > y) != (e["y2"] > y)) & ((_side(e, x, y) > 0) == (e["y2"] > e["y1"]))


def inside(x: Column, y: Column, ring_edges: Column) -> Column:
    """Whether a position is inside of, or on, the rings (even-odd)."""
    crossing = F.filter(ring_edges, lambda e: crosses(e, x, y))
    return (F.size(crossing) % 2 == 1) | F.exists(ring_edges, lambda e: on_edge(e, x, y))


def _segments_meet(a: Column, b: Column) -> Column:
    d1, d2 = _side(b, a["x1"], a["y1"]), _side(b, a["x2"], a["y2"])
    d3, d4 = _side(a, b["x1"], b["y1"]), _side(a, b["x2"], b["y2"])
    proper = (((d1 > 0) & (d2 < 0)) | ((d1 < 0) & (d2 > 0))) & (((d3 > 0) & (d4 < 0)) | ((d3 < 0) & (d4 > 0)))
    touch = on_edge(b, a["x1"], a["y1"]) | on_edge(b, a["x2"], a["y2"]) | on_edge(a, b["x1"], b["y1"]) | on_edge(a, b["x2"], b["y2"])
    return proper | touch


def intersects(coords: Column, geom_type: Column, polygon: Column) -> Column:
    """Whether a depth-4 geometry meets the polygon given by its segments."""
    corner = F.exists(vertices(coords), lambda p: inside(F.get(p, 0), F.get(p, 1), polygon))
    mine = edges(coords)
    crossing = F.exists(mine, lambda a: F.exists(polygon, lambda b: _segments_meet(a, b)))
    first = F.get(polygon, 0)
    around = geom_type.isin("Polygon", "MultiPolygon") & inside(first["x1"], first["y1"], mine)
    return F.when(geom_type.isin("Point", "MultiPoint"), corner).otherwise(corner | crossing | around)


def _positions(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.array_join(F.transform(p, _number), " ")), ", ")


def _number(v: Column) -> Column:
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def wkt(coords: Column, geom_type: Column) -> Column:
    """Well-known text of a depth-4 geometry."""

    def rings(polygon: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(polygon, lambda r: F.concat(F.lit("("), _positions(r), F.lit(")"))), ", "), F.lit(")"))

    line = F.get(F.get(coords, 0), 0)
    lines = F.get(coords, 0)
    return (
        F.when(geom_type == "Point", F.concat(F.lit("POINT ("), _positions(line), F.lit(")")))
        .when(geom_type == "MultiPoint", F.concat(F.lit("MULTIPOINT ("), _positions(line), F.lit(")")))
        .when(geom_type == "LineString", F.concat(F.lit("LINESTRING ("), _positions(line), F.lit(")")))
        .when(geom_type == "MultiLineString", F.concat(F.lit("MULTILINESTRING "), rings(lines)))
        .when(geom_type == "Polygon", F.concat(F.lit("POLYGON "), rings(lines)))
        .when(geom_type == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(coords, rings), ", "), F.lit(")")))
    )


def _wkb_bytes(coords, kind: str) -> bytes | None:
    if coords is None or kind not in TYPE_CODES:
        return None
    code = TYPE_CODES[kind]
    head = struct.Struct("<BI").pack

    def positions(ring) -> bytes:
        return struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", p[0], p[1]) for p in ring)

    def polygon(rings) -> bytes:
        return head(1, 3) + struct.pack("<I", len(rings)) + b"".join(map(positions, rings))

    first = coords[0]
    if kind == "Point":
        return head(1, 1) + struct.pack("<2d", *first[0][0][:2])
    if kind == "LineString":
        return head(1, 2) + positions(first[0])
    if kind == "Polygon":
        return polygon(first)
    if kind == "MultiPolygon":
        return head(1, code) + struct.pack("<I", len(coords)) + b"".join(map(polygon, coords))
    if kind == "MultiPoint":
        return head(1, code) + struct.pack("<I", len(first[0])) + b"".join(head(1, 1) + struct.pack("<2d", *p[:2]) for p in first[0])
    return head(1, code) + struct.pack("<I", len(first)) + b"".join(head(1, 2) + positions(r) for r in first)


@F.pandas_udf(T.BinaryType())
def to_wkb(coords: pd.Series, kind: pd.Series) -> pd.Series:
    """Well-known bytes of depth-4 coordinates."""
    return pd.Series([_wkb_bytes(c, k) for c, k in zip(coords, kind)])


@F.arrow_udf(COORDS_TYPE)
def from_wkb(data: pa.Array) -> pa.Array:
    """Depth-4 coordinates of well-known bytes."""
    return decode(data)
