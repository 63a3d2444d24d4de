"""kd-tree partitions, tiles and shards."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.curve import curve, curve_places
from ..sources.scratch import delete, listing, scratch, staged

#: Largest size of a partition in bytes.
MOST_BYTES = 2 * 1024**3


def partition_count(size: Column, most: int = MOST_BYTES) -> Column:
    """1 up to the limit, else the power of two at or above the number of limits."""
    parts = F.ceil(size / most).cast("bigint")
    return F.when(size <= most, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(parts - 1))).cast("bigint"))


def medians(df: DataFrame, node: Column, v: Column, accuracy: int = 100_000) -> dict[int, float]:
    """The median of ``v`` in each ``node``, the lower one of two: exact, whatever the number of rows.

    Two quantiles, off by one ``accuracy``-th of the rows at most, lie around it;
    the rows between them, some ``4 / accuracy`` of all, are counted by value. A
    median that isn't found there is looked for in a wider range.
    """
    rows = df.select(node.alias("node"), v.alias("v")).where("v is not null")
    out, left, near = {}, None, 2.0 / accuracy
    while left is None or left:
        asked = rows if left is None else rows.where(F.col("node").isin(left))
        near = min(near, 0.5)
        ends = F.percentile_approx("v", [0.5 - near, 0.5, 0.5 + near], accuracy).alias("ends")
        found = asked.groupBy("node").agg(F.count(F.lit(1)).alias("n"), ends).collect()  # a row a node
        sure = {r["node"]: r["ends"][1] for r in found if 2 * r["n"] <= accuracy}
        out |= sure
        around = [(r["node"], r["ends"][0], r["ends"][2], (r["n"] + 1) // 2) for r in found if r["node"] not in sure]
        if not around:
            break
        around = F.broadcast(df.sparkSession.createDataFrame(around, "node int, least double, most double, rank bigint"))
        # null: all that lies below
        value = F.when(F.col("v") >= F.col("least"), F.col("v")).alias("value")
        counts = asked.join(around, "node").where((F.col("v") <= F.col("most")) | (near == 0.5)).groupBy("node", "rank", value).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("node").orderBy(F.asc_nulls_first("value")))
        met = F.col("upto") >= F.col("rank")
        cuts = counts.withColumn("upto", upto).groupBy("node").agg(
            F.min(F.when(met, F.col("value"))).alias("cut"), F.coalesce(F.bool_or(met & F.col("value").isNull()), F.lit(False)).alias("below")
        )
        cuts = cuts.collect()  # a row a node
        out |= {r["node"]: r["cut"] for r in cuts if r["cut"] is not None and not r["below"]}
        left, near = [r["node"] for r in cuts if r["cut"] is None or r["below"]], near * 16
    return out


def kd_partition(df: DataFrame, leaves: int, box: str = "bbox", accuracy: int = 100_000) -> DataFrame:
    """Add ``kd_leaf``: halve at the median of alternate axes until there are so many leaves.

    A round aggregates the boxes' centres by node. The medians, fewer than
    ``leaves`` numbers in all, come to the driver and become an array in the
    next round's expression, so the plan grows by one expression a round and
    reads ``df`` once. ``accuracy`` is that of the quantiles between which
    :func:`medians` finds the exact ones.
    """
    depth = int(math.log2(leaves))
    if 1 << depth != leaves:
        raise ValueError("leaves must be a power of two")
    b = F.col(box)
    x, y = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
    leaf = F.lit(0)
    for k in range(depth):
        axis = x if k % 2 == 0 else y
        cuts = medians(df, leaf, axis, accuracy)
        known = ",".join("" if (c := cuts.get(i)) is None else repr(c) for i in range(1 << k))
        # one constant array, not a literal a node; an empty node has no cut and its left half takes all
        cut = F.get(F.transform(F.split(F.lit(known), ","), lambda t: F.nullif(t, F.lit("")).cast("double")), leaf)
        leaf = leaf * 2 + F.coalesce((axis > cut).cast("int"), F.lit(0))
    return df.withColumn("kd_leaf", leaf)


def leaf_bytes(spark: SparkSession, path: str, key: str = "kd_leaf") -> DataFrame:
    """``part`` and ``bytes``: the size of each partition of a written table, by the folders of ``key``."""
    with listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", f"/{key}=([^/]+)/", 1).alias("part")).agg(F.sum("length").alias("bytes"))


def oversized(spark: SparkSession, path: str, most: int, key: str = "kd_leaf") -> DataFrame:
    """Partitions of a written table whose files are larger than the limit together."""
    return leaf_bytes(spark, path, key).where(F.col("bytes") > most)


def row_bytes(df: DataFrame, level: int, rows: int = 200_000) -> float:
    """Bytes that a row takes when it is written: measured on a sample of some ``rows`` rows."""
    n = df.count()
    if not n:
        return 0.0
    path = scratch(df.sparkSession, "sample")
    share = min(1.0, rows / n)
    df.sample(share, seed=1).write.options(**_options(level)).parquet(path)
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path).count()
    return (files.agg(F.sum("length")).first()[0] or 0) / max(1, written)


#: Rows of a sample from which upper cuts are taken, and of a group that a task cuts on; compressed bytes of such a group.
SAMPLE_ROWS, GROUP_ROWS, GROUP_BYTES = 200_000, 200_000, 16 * 1024**2


def _centres(box: str) -> tuple[Column, Column]:
    b = F.col(box)
    return (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2


def _bit(numbers: np.ndarray, level: int) -> np.ndarray:
    """A bit of each row's hashed number, another one for each level."""
    h = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(63 - level)) & np.uint64(1) == 1


def _cut(leaf: int, x: np.ndarray, y: np.ndarray) -> tuple[str, float, bool]:
    """Where a leaf is halved: axis, median, and whether the median itself belongs to the right half.

    The axis is that of the leaf's level, the other one if the centres agree in
    that, and the row's number if they agree in both. Centres may be missing.
    """
    level = leaf.bit_length() - 1
    for axis, v in (("x", x), ("y", y)) if level % 2 == 0 else (("y", y), ("x", x)):
        v = v[~np.isnan(v)]
        if len(v) and v.min() < (most := v.max()):
            at = (len(v) - 1) // 2
            cut = float(np.partition(v, at)[at])
            return axis, cut, cut >= most
    return "row", 0.0, False


def _right(leaf: int, cut: tuple[str, float, bool], x: np.ndarray, y: np.ndarray, number: np.ndarray) -> np.ndarray:
    axis, at, begins = cut
    if axis == "row":
        return _bit(number, leaf.bit_length() - 1)
    v = x if axis == "x" else y
    return v >= at if begins else v > at  # a missing centre goes left


def _halved(leaf: int, x: np.ndarray, y: np.ndarray, number: np.ndarray, most: float, cuts: dict | None = None) -> np.ndarray:
    """Leaves of rows that are all in ``leaf``, halved until none has more than ``most``; fills ``cuts``."""
    out = np.full(len(x), leaf, np.int64)
    todo = [(leaf, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        out[rows] = k
        if len(rows) <= max(1, most) or k.bit_length() >= 63:
            continue
        cut = _cut(k, x[rows], y[rows])
        if cut[0] == "row" and cuts is None:  # all rows are here: halved evenly
            right = np.arange(len(rows)) >= (len(rows) + 1) // 2
        else:
            right = _right(k, cut, x[rows], y[rows], number[rows])
        if cuts is not None:
            cuts[k] = cut
        todo += [(2 * k, rows[~right]), (2 * k + 1, rows[right])]
    return out


def _upper(df: DataFrame, rows: dict[int, int], most_rows: dict[int, float], box: str) -> DataFrame:
    """Halve leaves by cuts of a sample of their rows, as far as the sample tells that they have more than ``most_rows``."""
    large = {k: n for k, n in rows.items() if n > most_rows[k]}
    if not large:
        return df
    x, y = _centres(box)
    share = min(1.0, SAMPLE_ROWS / sum(large.values()))
    places = df.where(F.col("kd_leaf").isin(list(large))).select("kd_leaf", x.alias("x"), y.alias("y"), F.col("_row").alias("number"))
    cuts: dict[int, tuple[str, float, bool]] = {}
    for leaf, part in places.sample(share, seed=1).toPandas().groupby("kd_leaf"):  # a sample of a set size
        leaf = int(leaf)
        # as many of the sample as stand for the limit, but enough for a median
        most = max(32.0, most_rows[leaf] * len(part) / large[leaf])
        _halved(leaf, *(part[c].to_numpy(float) for c in "xy"), part["number"].to_numpy(np.int64), most, cuts)
    if not cuts:
        return df

    @F.pandas_udf("bigint")
    def place(leaf: pd.Series, x: pd.Series, y: pd.Series, number: pd.Series) -> pd.Series:
        out, x, y, number = leaf.to_numpy(np.int64).copy(), x.to_numpy(float), y.to_numpy(float), number.to_numpy(np.int64)
        todo = [(int(k), np.flatnonzero(out == k)) for k in np.unique(out)]
        while todo:
            k, at = todo.pop()
            out[at] = k
            if k in cuts and len(at):
                right = _right(k, cuts[k], x[at], y[at], number[at])
                todo += [(2 * k, at[~right]), (2 * k + 1, at[right])]
        return pd.Series(out)

    return df.withColumn("kd_leaf", place("kd_leaf", x, y, "_row"))


def _lower(df: DataFrame, most_rows: dict[int, float], box: str) -> DataFrame:
    """Halve leaves that fit into a task until none has more than the ``most_rows`` of the leaf that it descends from; rows come out along the curve in each."""
    x, y = _centres(box)
    keyed = df.withColumn("_x", x.cast("double")).withColumn("_y", y.cast("double"))

    def within(group):
        import pyarrow as pa

        leaf = at = group.column("kd_leaf")[0].as_py()
        while at not in most_rows:
            at >>= 1
        xs, ys = (group.column(c).to_numpy().astype(float) for c in ("_x", "_y"))
        leaves = _halved(leaf, xs, ys, group.column("_row").to_numpy(), most_rows[at])
        group = group.drop_columns(["_x", "_y"])
        group = group.set_column(group.schema.get_field_index("kd_leaf"), "kd_leaf", pa.array(leaves, pa.int64()))
        return group.take(np.lexsort((curve_places(xs, ys), leaves)))

    return keyed.groupBy("kd_leaf").applyInArrow(within, df.schema)


def split_leaves(df: DataFrame, rows: dict[int, int], most_rows: dict[int, float], group: float = GROUP_ROWS, box: str = "bbox") -> tuple[DataFrame, bool]:
    """Halve the leaves ``kd_leaf`` of ``df``, which have so many ``rows``, until none should have more than its ``most_rows``.

    Upper cuts are medians of a sample of the centres, so the number of passes
    doesn't depend on the depth. Leaves of fewer than ``group`` rows, to which a
    task can hold all rows, are cut there at exact medians. Also tells whether
    rows now lie together by leaf. ``df`` has a number ``_row`` for each row.
    """
    if min(most_rows.values()) >= group:
        return _upper(df, rows, most_rows, box), False
    return _lower(_upper(df, rows, {k: max(group, m) for k, m in most_rows.items()}, box), most_rows, box), True


def _pilot(start: DataFrame, n: int, most: int, most_rows: float, group: float, level: int, box: str) -> float:
    """``most_rows``, less if small files turn out to take more bytes a row than the sample's large ones: measured on the leaves of one group."""
    spark, path = start.sparkSession, scratch(start.sparkSession, "pilot")
    upper = _upper(start, {1: n}, {1: group}, box)
    one = upper.groupBy("kd_leaf").count().orderBy(F.desc("count"), "kd_leaf").first()["kd_leaf"]
    leaves = _lower(upper.where(F.col("kd_leaf") == one), {1: most_rows}, box)
    write_partitioned(leaves, path, level, together=True)
    largest = leaf_bytes(spark, path).agg(F.max("bytes")).first()[0]
    return most_rows * min(1.0, 0.95 * most / largest)


def write_bounded(df: DataFrame, path: str, most: int = MOST_BYTES, level: int = 3, box: str = "bbox") -> int:
    """Write partitions ``kd_leaf``, none of which is larger than ``most`` bytes unless it is a single row; returns how many there are.

    A leaf is known by its place in the tree: 1 is all, 2k and 2k + 1 are the
    halves of k, so leaves of uneven depth have names of their own. The bytes of a
    row, measured on a written sample, tell how far to halve before anything is
    written. What is written is measured; only leaves beyond the limit are read
    again, halved by their own bytes a row, and written in place of themselves.
    """
    spark = df.sparkSession
    n = df.count()
    each = row_bytes(df, level)
    group = min(GROUP_ROWS, max(1, GROUP_BYTES / each)) if each else GROUP_ROWS
    start = df.withColumn("kd_leaf", F.lit(1).cast("bigint")).withColumn("_row", F.monotonically_increasing_id())
    most_rows = most / each if each else max(n, 1)
    if n > group > most_rows:
        most_rows = _pilot(start, n, most, most_rows, group, level, box)
    leaves, together = split_leaves(start, {1: n}, {1: most_rows}, group, box)
    write_partitioned(leaves, path, level, together=together)
    while large := {int(r["part"]): r["bytes"] for r in oversized(spark, path, most).collect()}:  # few rows: leaves beyond the limit
        with listing(spark):
            stored = spark.read.schema(start.drop("_row").schema).parquet(path).withColumn("_row", F.monotonically_increasing_id())
        rows = {r["kd_leaf"]: r["count"] for r in stored.where(F.col("kd_leaf").isin(list(large))).groupBy("kd_leaf").count().collect()}
        rows = {k: n for k, n in rows.items() if n > 1}
        if not rows:
            break
        # a little below the limit, since smaller files compress less
        limits = {k: min(0.9 * most * n / large[k], n / 2) for k, n in rows.items()}
        for few in (True, False):  # leaves that a task can hold, others
            these = [k for k, m in limits.items() if (m < group) is few]
            if these:
                again = stored.where(F.col("kd_leaf").isin(these))
                leaves, together = split_leaves(again, {k: rows[k] for k in these}, {k: limits[k] for k in these}, group, box)
                write_partitioned(leaves, path, level, mode="append", together=together)
        for k in rows:
            delete(spark, f"{path}/kd_leaf={k}")
    return leaf_bytes(spark, path).count()


def _options(level: int) -> dict:
    return {"compression": "zstd", "parquet.compression.codec.zstd.level": level}


def write_partitioned(df: DataFrame, path: str, level: int = 3, mode: str = "overwrite", box: str = "bbox", together: bool = False) -> None:
    """One folder per leaf; within it rows along a Hilbert curve, so that files and row groups can be skipped in both axes.

    Tasks take ranges of leaf, curve and row, so a leaf of many rows is written by
    several; rows that lie ``together`` by leaf, along the curve, stay where they
    are. High levels cost much for each page; 15 is meant for files to publish.
    """
    # rows at one place on the curve are spread by a number of their own
    placed, keys = df.withColumn("_row", F.monotonically_increasing_id()), ["kd_leaf", "_row"]
    if not together:
        keys.insert(1, "_curve")
        placed = placed.withColumn("_curve", curve(F.col(box))).repartitionByRange(*keys)
    placed = placed.sortWithinPartitions(*keys).drop("_curve", "_row")
    placed.write.options(**_options(level)).partitionBy("kd_leaf").mode(mode).parquet(path)


def tile_x(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.greatest(F.lit(0), F.least((n - 1).cast("bigint"), F.floor((lon + 180.0) / 360.0 * n))).cast("bigint")


def tile_y(lat: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    r = F.radians(lat)
    return F.greatest(F.lit(0), F.least((n - 1).cast("bigint"), F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n))).cast("bigint")


def tile_assign(df: DataFrame, zooms: range, box: str = "bbox") -> DataFrame:
    """A row for each feature, zoom and web-mercator tile that its box covers."""
    b = F.col(box)
    z = df.withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    x = z.withColumn("x", F.explode(F.sequence(tile_x(b["xmin"], F.col("z")), tile_x(b["xmax"], F.col("z")))))
    return x.withColumn("y", F.explode(F.sequence(tile_y(b["ymax"], F.col("z")), tile_y(b["ymin"], F.col("z")))))


def tile_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("features"))


def _shifted(v: Column, by: Column) -> Column:
    """``v >> by`` for columns, of numbers that aren't negative."""
    return F.floor(v / F.pow(F.lit(2.0), by)).cast("bigint")


def tile_cover(df: DataFrame, zoom: int, box: str = "bbox") -> DataFrame:
    """Add the tiles ``struct(z, x, y)``, as ``tile``, a row each, that together are the tiles of ``zoom`` that the box covers.

    A tile of which the box covers all parts of ``zoom`` stays whole, so a box
    costs rows in proportion to its outline and not to its area. Each begins at
    the smallest tile that holds it and is cut into quarters where it must.
    """
    b = F.col(box)
    z = F.lit(zoom)
    ends = [tile_x(b["xmin"], z), tile_x(b["xmax"], z), tile_y(b["ymax"], z), tile_y(b["ymin"], z)]
    df = df.where(b["xmin"].isNotNull()).withColumn("_r", F.struct(*[v.alias(n) for v, n in zip(ends, ("x0", "x1", "y0", "y1"))]))
    r = F.col("_r")
    differ = r["x0"].bitwiseXOR(r["x1"]).bitwiseOR(r["y0"].bitwiseXOR(r["y1"]))
    up = F.when(differ == 0, 0).otherwise(F.length(F.bin(differ)))
    df = df.withColumn("tile", F.struct((z - up).cast("int").alias("z"), _shifted(r["x0"], up).alias("x"), _shifted(r["y0"], up).alias("y")))
    for k in range(zoom):
        side = 1 << (zoom - k)
        t = F.col("tile")
        whole = (t["x"] * side >= r["x0"]) & ((t["x"] + 1) * side - 1 <= r["x1"]) & (t["y"] * side >= r["y0"]) & ((t["y"] + 1) * side - 1 <= r["y1"])
        quarters = [F.struct((t["z"] + 1).alias("z"), (t["x"] * 2 + i).alias("x"), (t["y"] * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)]
        half = side // 2
        met = F.filter(F.array(*quarters), lambda q: (q["x"] * half <= r["x1"]) & ((q["x"] + 1) * half - 1 >= r["x0"]) & (q["y"] * half <= r["y1"]) & ((q["y"] + 1) * half - 1 >= r["y0"]))
        df = df.withColumn("tile", F.explode(F.when((t["z"] != k) | whole, F.array(t)).otherwise(met)))
    return df.drop("_r")


def tile_pyramid(df: DataFrame, finest: int, coarsest: int = 0, box: str = "bbox") -> DataFrame:
    """Features by tile for all zooms: ``zoom``, a tile ``z, x, y`` of that zoom or a coarser one, and the ``features`` that cover all of it.

    A tile of the zoom has the features of its row and of all rows around it.
    Features within one tile of the finest zoom are counted there once, and each
    coarser zoom adds up the counts of the one below; only the others are covered
    by zoom.
    """
    b, z = F.col(box), F.lit(finest)
    placed = df.where(b["xmin"].isNotNull()).withColumn("_x", tile_x(b["xmin"], z)).withColumn("_y", tile_y(b["ymin"], z))
    one = (tile_x(b["xmax"], z) == F.col("_x")) & (tile_y(b["ymax"], z) == F.col("_y"))
    level = placed.where(one).groupBy(F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.count(F.lit(1)).alias("features"))
    out = None
    for zoom in range(finest, coarsest - 1, -1):
        if zoom < finest:
            level = level.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.sum("features").alias("features"))
        level = staged(level, "level")
        single = level.select(F.lit(zoom).alias("zoom"), F.lit(zoom).alias("z"), "x", "y", "features")
        several = tile_cover(placed.where(~one), zoom, box).groupBy("tile").agg(F.count(F.lit(1)).alias("features")).select(F.lit(zoom).alias("zoom"), "tile.*", "features")
        out = single.unionByName(several) if out is None else out.unionByName(single).unionByName(several)
    return out.groupBy("zoom", "z", "x", "y").agg(F.sum("features").alias("features"))


def pyramid_counts(pyramid: DataFrame, zooms: list[int]) -> DataFrame:
    """``z, x, y`` and ``features`` of every tile of the zooms that has any: coarse rows of :func:`tile_pyramid` cut into tiles."""
    rows = pyramid.where(F.col("zoom").isin(zooms))
    by = F.col("zoom") - F.col("z")
    n = F.pow(F.lit(2.0), by).cast("bigint")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    rows = rows.select(F.col("zoom").alias("z"), (F.col("x") * n + F.col("_i")).alias("x"), (F.col("y") * n + F.col("_j")).alias("y"), "features")
    return rows.groupBy("z", "x", "y").agg(F.sum("features").alias("features"))


def thin_tiles(tiles: DataFrame, n: int, key: str = "id") -> DataFrame:
    """At most ``n`` features in a tile, chosen by the order of their hashed ids.

    Hashes are spread evenly, so the ``n`` least of a tile of many features lie below
    a bound that follows from its count. Only those are ordered, and a tile where
    they turn out to be fewer than ``n`` is ordered whole.
    """
    at = ["z", "x", "y"]
    tiles = tiles.withColumn("_h", F.crc32(F.col(key).cast("string")))
    share = (n + 8 * math.sqrt(n) + 16) / F.col("features")
    dense = staged(tile_counts(tiles).where(share < 1).select(*at, (share * (1 << 32)).cast("bigint").alias("_cut")), "dense")
    below = tiles.join(dense, at, "left").where(F.col("_cut").isNull() | (F.col("_h") < F.col("_cut")))
    enough = below.where(F.col("_cut").isNotNull()).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    few = staged(dense.join(enough, at, "left").where(F.coalesce("_n", F.lit(0)) < n).select(*at), "few")
    below = below.drop("_cut")
    if not few.isEmpty():
        below = below.join(few, at, "left_anti").unionByName(tiles.join(few, at, "left_semi"))
    order = Window.partitionBy(*at).orderBy("_h", key)
    return below.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n", "_h")


def spacing(df: DataFrame, box: str = "bbox", key: str = "id") -> DataFrame:
    """Add ``gap``: how far along the curve the feature before lies, by ``key`` where they are at one place; null for the first one and those without a box.

    A tile is one stretch of a curve, so one pass serves tiles of all zooms.
    """
    placed = df.withColumn("_curve", curve(F.col(box)))
    # written, so that the ranges are the same in both uses
    parted = staged(placed.repartitionByRange("_curve", key).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = parted.groupBy("_part").agg(F.max("_curve").alias("_last"))
    ends = ends.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_from"))  # a row a range
    before = F.lag("_curve").over(Window.partitionBy("_part").orderBy("_curve", key))
    gaps = parted.withColumn("_before", before).join(F.broadcast(ends), "_part")
    return gaps.withColumn("gap", F.col("_curve") - F.coalesce("_before", "_from")).drop("_curve", "_part", "_before", "_from")


#: Parts into which features of like spacing are dealt by their hashed ids.
PARTS = 256


def fit_tiles(tiles: DataFrame, limit_bytes: int, size: str = "bytes", key: str = "id", gap: str = "gap") -> DataFrame:
    """Rows of ``tiles`` without the densest features of each tile, so that none holds more than ``limit_bytes``.

    Features are ranked by the power of two of their ``gap``, widest first, and
    among those by a part of their hashed id. Sizes are added up by tile and rank,
    of which a tile has some thousands at most whatever it holds; ranks are kept
    as long as they fit together, whole.
    """
    at = ["z", "x", "y"]
    wide = F.when(F.col(gap).isNull(), 0).otherwise(64 - F.length(F.bin(F.col(gap))))
    ranked = tiles.withColumn("_rank", (wide * PARTS + F.pmod(F.crc32(F.col(key).cast("string")), F.lit(PARTS))).cast("int"))
    sums = ranked.groupBy(*at, "_rank").agg(F.sum(size).alias("_bytes"))
    total = F.sum("_bytes").over(Window.partitionBy(*at).orderBy("_rank"))
    cuts = sums.withColumn("_total", total).where(F.coalesce("_total", F.lit(0)) <= limit_bytes).groupBy(*at).agg(F.max("_rank").alias("_cut"))
    return ranked.join(staged(cuts, "cuts"), at).where(F.col("_rank") <= F.col("_cut")).drop("_rank", "_cut")


def running_total(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over all earlier rows, without a global window.

    Spark deals the rows to its shuffle partitions by ranges of the order; each
    range sums its own rows, and the ranges' totals, one row a range, are summed
    and joined back.
    """
    # written, so that the ranges are the same in both uses
    parted = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offset = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_part", offset.alias("_offset"))
    summed = parted.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(offsets), "_part")
    return summed.withColumn("before", F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def _following(end: np.ndarray, limit: int, before: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first tile of the shard after the one that begins at each of ``at``, and the total that shard may not reach beyond."""
    total = before[at] + limit
    return np.maximum(np.searchsorted(end, total, "right"), at + 1), total


def _walk(before: np.ndarray, end: np.ndarray, limit: int, entry: np.ndarray, each=None) -> np.ndarray:
    """Go from shard to shard of a block until it ends; the totals to go on from, -1: at the next block's first tile."""
    at, out = np.searchsorted(end, entry, "right"), np.full(len(entry), -1, np.int64)
    open_ = np.flatnonzero(at < len(end))
    while len(open_):
        if each:
            each(at[open_])
        at[open_], total = _following(end, limit, before, at[open_])
        left = at[open_] >= len(end)
        out[open_[left]] = np.where(total[left] >= end[-1], total[left], -1)
        open_ = open_[~left]
    return out


def _totals(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["before", "size", "_at"], ignore_index=True)
    before = pdf["before"].to_numpy(np.int64)
    return pdf, before, before + pdf["size"].to_numpy(np.int64)


def pack_shards(tiles: DataFrame, limit_bytes: int, size: str = "bytes", blocks: int = 32) -> DataFrame:
    """Add ``shard``: tiles in order of zoom and place, each put into the shard before unless that would pass the limit.

    No shard is larger than the limit unless it is a single tile. Where a shard
    ends depends on where it began, so tiles are taken in blocks of ``blocks``
    limits of running size. A shard that goes on beyond a block is known to the
    next one by the total that it may reach, one of those of the block's last tiles; each
    block works out, for all of them, the total that it hands on. Pointer doubling
    over blocks finds the one total that comes to each, and each block numbers its
    shards. A null size counts as 0.
    """
    code = F.col("z").cast("bigint") * (1 << 50) + F.col("x").cast("bigint") * (1 << 25) + F.col("y").cast("bigint")
    summed = tiles.withColumn("_code", code).withColumn("_size", F.coalesce(F.col(size).cast("bigint"), F.lit(0)))
    summed = running_total(summed, ["_code"], "_size").withColumn("_at", F.monotonically_increasing_id())
    summed = staged(summed.withColumn("_block", F.floor(F.col("before") / (limit_bytes * blocks))), "summed")
    narrow = summed.select("_block", "_at", "before", F.col("_size").alias("size"))
    # a row a block
    following = F.lead("_block").over(Window.orderBy("_block"))
    ends = staged(narrow.groupBy("_block").agg(F.max(F.col("before") + F.col("size")).alias("_end")).withColumn("_next", following), "blocks")
    leaving = narrow.join(ends, "_block").where((F.col("before") + limit_bytes >= F.col("_end")) & F.col("_next").isNotNull())
    entries = leaving.select(F.col("_next").alias("_block"), (F.col("before") + limit_bytes).alias("entry")).distinct()
    entries = entries.unionByName(ends.select("_block", F.lit(-1).cast("bigint").alias("entry")))

    def through(tiles_: pd.DataFrame, entries_: pd.DataFrame) -> pd.DataFrame:
        _, before, end = _totals(tiles_)
        out = _walk(before, end, limit_bytes, entries_["entry"].to_numpy(np.int64))
        return pd.DataFrame({"_block": entries_["_block"], "entry": entries_["entry"], "exit": out})

    edges = narrow.groupBy("_block").cogroup(entries.groupBy("_block")).applyInPandas(through, "_block bigint, entry bigint, exit bigint")
    jump = edges.join(ends.select("_block", "_next"), "_block").where("_next is not null")
    jump = staged(jump.select("_block", "entry", F.col("_next").alias("to"), "exit"), "jump")
    reached = ends.agg(F.min("_block").alias("_block")).where("_block is not null").select("_block", F.lit(-1).cast("bigint").alias("entry"))
    n, done = ends.count(), 1
    while done < n:
        reached = reached.unionByName(reached.join(jump, ["_block", "entry"]).select(F.col("to").alias("_block"), F.col("exit").alias("entry")))
        done *= 2
        reached = staged(reached, "reached")
        if done < n:
            on = jump.select(F.col("_block").alias("to"), F.col("entry").alias("exit"), F.col("to").alias("_to"), F.col("exit").alias("_exit"))
            jump = staged(jump.join(on, ["to", "exit"]).select("_block", "entry", F.col("_to").alias("to"), F.col("_exit").alias("exit")), "jump")

    def numbered(tiles_: pd.DataFrame, entries_: pd.DataFrame) -> pd.DataFrame:
        tiles_, before, end = _totals(tiles_)
        starts: list[np.ndarray] = []
        _walk(before, end, limit_bytes, entries_["entry"].to_numpy(np.int64), starts.append)
        begun = np.zeros(len(end), np.int64)
        if starts:  # else the shard before goes on through all of the block
            begun[np.concatenate(starts)] = 1
        return pd.DataFrame({"_block": tiles_["_block"], "_at": tiles_["_at"], "_in": np.cumsum(begun)})

    parts = narrow.groupBy("_block").cogroup(reached.groupBy("_block")).applyInPandas(numbered, "_block bigint, _at bigint, _in bigint")
    parts = staged(parts, "numbered")
    before_block = F.coalesce(F.sum("_most").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("_block").agg(F.max("_in").alias("_most")).select("_block", before_block.alias("_offset"))
    shards = parts.join(offsets, "_block").select("_at", (F.col("_offset") + F.col("_in") - 1).alias("shard"))
    return summed.join(shards, "_at").drop("_at", "_block", "_code", "_size")


def shard_manifest(shards: DataFrame) -> DataFrame:
    """Bounds and zooms of each shard, degrees times 1e7."""
    from ..functions.scalars import tile_bbox_e7

    b = shards.withColumn("_b", tile_bbox_e7(F.col("z"), F.col("x"), F.col("y")))
    return b.groupBy("shard").agg(
        F.min("_b.w").alias("min_lon_e7"), F.min("_b.s").alias("min_lat_e7"), F.max("_b.e").alias("max_lon_e7"), F.max("_b.n").alias("max_lat_e7"),
        F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count(F.lit(1)).alias("tiles"),
    )
