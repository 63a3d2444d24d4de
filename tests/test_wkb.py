"""Well-known bytes in both byte orders, against a plain reader."""

import random
import struct

import pyarrow as pa

from geoloom.functions.geometry import TYPE_CODES, from_wkb, to_wkb
from geoloom.functions.wkb import decode

KINDS = list(TYPE_CODES)


def encode(rng, kind, coords):
    """Depth-4 coordinates as bytes, each part in a byte order of its own."""
    mark = rng.choice("<>")
    head = bytes([mark == "<"]) + struct.pack(mark + "I", TYPE_CODES[kind])
    count = lambda v: struct.pack(mark + "I", len(v))
    flat = lambda ring: count(ring) + b"".join(struct.pack(mark + "2d", *p) for p in ring)
    first = coords[0] if coords else []
    if kind == "Point":
        return head + struct.pack(mark + "2d", *first[0][0])
    if kind == "LineString":
        return head + flat(first[0])
    if kind == "Polygon":
        return head + count(first) + b"".join(map(flat, first))
    if kind == "MultiPoint":
        return head + count(first[0]) + b"".join(encode(rng, "Point", [[[p]]]) for p in first[0])
    if kind == "MultiLineString":
        return head + count(first) + b"".join(encode(rng, "LineString", [[r]]) for r in first)
    return head + count(coords) + b"".join(encode(rng, "Polygon", [p]) for p in coords)


def geometry(rng):
    kind = rng.choice(KINDS)
    positions = lambda k: [[rng.uniform(-180, 180), rng.uniform(-90, 90)] for _ in range(k)]
    rings = lambda k: [positions(rng.randint(0, 5)) for _ in range(k)]
    if kind == "Point":
        return kind, [[positions(1)]]
    if kind in ("LineString", "MultiPoint"):
        return kind, [[positions(rng.randint(1, 6))]]
    if kind in ("Polygon", "MultiLineString"):
        return kind, [rings(rng.randint(1, 5))]
    return kind, [rings(rng.randint(0, 4)) for _ in range(rng.randint(1, 4))]


def test_random_geometries():
    rng = random.Random(4)
    for size in (0, 1, 7, 400):
        cases = [geometry(rng) if rng.random() < 0.9 else None for _ in range(size)]
        data = pa.array([c and encode(rng, *c) for c in cases], pa.binary())
        assert decode(data).to_pylist() == [c and c[1] for c in cases]
        assert decode(data[size // 3 :]).to_pylist() == [c and c[1] for c in cases[size // 3 :]]
        assert decode(data.cast(pa.large_binary())).to_pylist() == [c and c[1] for c in cases]


def test_odd_bytes():
    none = struct.pack("<BI", 1, 6) + struct.pack("<I", 0)
    bare = struct.pack("<BI", 1, 3) + struct.pack("<I", 0)
    assert decode(pa.array([none, bare, None], pa.binary())).to_pylist() == [[], [[]], None]
    assert decode(pa.array([None, None], pa.binary())).to_pylist() == [None, None]
    try:
        decode(pa.array([struct.pack("<BI", 1, 9) + b"\0" * 16]))
        raise AssertionError("no error")
    except ValueError:
        pass


def test_round_trip_through_spark(spark):
    rng = random.Random(6)
    rows = [(i, *geometry(rng)) for i in range(60)] + [(60, None, None)]
    rows = [r for r in rows if r[1] is None or all(p for p in r[2])]
    df = spark.createDataFrame(rows, "id int, kind string, coords array<array<array<array<double>>>>")
    got = df.select("id", from_wkb(to_wkb("coords", "kind")).alias("c")).collect()
    assert {r["id"]: r["c"] for r in got} == {r[0]: r[2] for r in rows}
