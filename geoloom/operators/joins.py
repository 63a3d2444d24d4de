"""Spatial joins: partition pruning, tiles to slices, features to polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.cover import FINEST, MOST, cover_cells, in_cell
from ..functions.scalars import tile_bbox_e7
from ..sources.scratch import staged


def prune_partitions(features: DataFrame, extents: DataFrame, rings: list | None, key: str = "kd_leaf") -> DataFrame:
    """Features of the partitions whose extent meets the polygon (no polygon: all).

    The few surviving keys join to the partition column, so Spark prunes the scan.
    """
    if rings is None:
        return features
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    near = (F.col("minx") <= max(xs)) & (F.col("maxx") >= min(xs)) & (F.col("miny") <= max(ys)) & (F.col("maxy") >= min(ys))
    corners = [F.array(F.col(x), F.col(y)) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))]
    box = F.array(F.array(F.array(*corners)))
    left = extents.where(near).where(G.intersects(box, F.lit("Polygon"), G.polygon_edges(rings))).select(key)
    return features.join(left, key, "left_semi")


def prune_files(extents: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Files whose extent overlaps the box; those of unknown extent stay."""
    w, s, e, n = map(float, bbox)
    overlap = (F.col("minx") <= e) & (F.col("maxx") >= w) & (F.col("miny") <= n) & (F.col("maxy") >= s)
    return extents.where(F.col("minx").isNull() | overlap)


def first_match(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The row with the least ``pos`` of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def _finest(slices: DataFrame, widest: int = 32) -> int:
    """How often the world may be halved into cells so that slices cover ``widest`` cells each on average, and tiles few."""
    least = F.least(F.min("min_zoom"), F.lit(16)) + 3
    cells = []
    for k in range(17):
        side = 3_600_000_000 / (1 << k)
        cells.append(F.avg(((F.col("max_lon_e7") - F.col("min_lon_e7")) / side + 2) * ((F.col("max_lat_e7") - F.col("min_lat_e7")) / side + 2)).alias(f"c{k}"))
    r = slices.agg(least.alias("least"), *cells).first()  # one row
    return max([k for k in range(17) if r[f"c{k}"] is not None and k <= r["least"] and r[f"c{k}"] <= widest], default=0)


def tile_to_slice(tiles: DataFrame, slices: DataFrame, symmetric: bool = False, cell: int | None = None) -> DataFrame:
    """The first slice, in manifest order, that serves each tile ``(z, x, y)``.

    Latitudes must overlap; longitudes of the tile must lie within the slice's
    (``symmetric``: overlap). Slices meet tiles of their zooms in square cells,
    ``2**cell`` to the world's width, which are chosen by the slices' extents. Of
    slices with the same extent and zooms only the first can be an answer, so
    the others don't meet tiles.
    """
    extent = ["min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7", "min_zoom", "max_zoom"]
    slices = slices.groupBy(*extent).agg(F.min(F.struct("slice_pos", "slice")).alias("_first")).select(*extent, "_first.*")
    b = tile_bbox_e7(F.col("z"), F.col("x"), F.col("y"))
    tiles = tiles.select("z", "x", "y").distinct().withColumn("_b", b)
    side = 3_600_000_000 // (1 << (_finest(slices) if cell is None else cell))

    def at(v: Column) -> Column:
        return F.floor((v + 1_800_000_000) / side).cast("int")

    # a tile that a slice contains begins within its longitudes; else it may begin before
    columns = F.sequence(at(F.col("_b.w")), F.greatest(at(F.col("_b.w")), at(F.col("_b.e")))) if symmetric else F.array(at(F.col("_b.w")))
    rows = F.sequence(at(F.col("_b.s")), at(F.col("_b.n")))
    tiles = tiles.withColumn("_i", F.explode(columns)).withColumn("_j", F.explode(rows))
    s = slices.withColumn("z", F.explode(F.sequence("min_zoom", "max_zoom")))
    s = s.withColumn("_i", F.explode(F.sequence(at(F.col("min_lon_e7")), at(F.col("max_lon_e7"))))).withColumn("_j", F.explode(F.sequence(at(F.col("min_lat_e7")), at(F.col("max_lat_e7")))))
    lat = (F.col("_b.s") <= F.col("max_lat_e7")) & (F.col("_b.n") >= F.col("min_lat_e7"))
    if symmetric:
        lon = (F.col("_b.w") <= F.col("max_lon_e7")) & (F.col("_b.e") >= F.col("min_lon_e7"))
    else:
        lon = (F.col("_b.e") <= F.col("max_lon_e7")) & (F.col("_b.w") >= F.col("min_lon_e7"))
    met = tiles.join(s, ["z", "_i", "_j"]).where(lat & lon)
    best = F.min(F.struct("slice_pos", "slice")).alias("best")  # combines before the shuffle; a pair may meet in several cells
    return met.groupBy("z", "x", "y").agg(best).select("z", "x", "y", "best.slice")


def _level(b: Column) -> Column:
    """The finest level whose cells are no smaller than the box, so that the box covers four of them at most."""
    size = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    return F.when(size <= 360.0 / (1 << FINEST), FINEST).otherwise(F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / size)).cast("int")))


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v * F.pow(F.lit(2.0), level) / 360.0).cast("bigint")


def _cells(b: Column, levels: Column) -> Column:
    """Cells ``struct(level, x, y)`` of the levels that the box covers."""

    def of(level: Column) -> Column:
        xs, ys = F.sequence(_cell(b["xmin"], level), _cell(b["xmax"], level)), F.sequence(_cell(b["ymin"], level), _cell(b["ymax"], level))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))))

    return F.flatten(F.transform(levels, of))


#: As many frequent cells are dealt to several keys; any other has less than a thousandth of the features.
HOT_CELLS = 1000


def _salted(keyed: DataFrame, cells: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``: features of a cell with more than ``rows`` of them are dealt to several keys by all that they hold, its polygons copied to each."""
    counts = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    hot = counts.join(cells, "_cell", "left_semi").orderBy(F.desc("n")).limit(HOT_CELLS).collect()  # a thousand at most
    if not hot:
        return keyed.withColumn("_salt", F.lit(0)), cells.withColumn("_salt", F.lit(0))
    parts = F.create_map(*[v for r in hot for v in (F.lit(_key_text(r["_cell"])), F.lit(-(-r["n"] // rows)))])
    c = F.col("_cell")
    n = F.coalesce(F.element_at(parts, F.concat_ws("/", c["whole"].cast("int"), c["level"], c["x"], c["y"])), F.lit(1)).cast("int")
    values = [f"`{f.name}`" for f in keyed.schema if "map<" not in f.dataType.simpleString()]
    return keyed.withColumn("_salt", F.pmod(F.xxhash64(*values), n).cast("int")), cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))


def _key_text(cell) -> str:
    return f"{int(cell['whole'])}/{cell['level']}/{cell['x']}/{cell['y']}"


def spatial_join(features: DataFrame, polygons: DataFrame, how: str = "inner", hot: int = 1_000_000, small: int = 10 * 1024**2) -> DataFrame:
    """Features and the polygons that they meet; ``left_semi`` gives the features alone.

    Points meet the cells that cover a polygon (:mod:`..functions.cover`): a
    point lies in one cell of each level, cells of a polygon don't overlap, so a
    pair meets once; inner cells need no test, others have few edges.

    Other geometries meet whole polygons in a hierarchy of grids: a box has the
    level whose cells are as large as itself, and a pair meets at the coarser of
    its two levels, so no box covers more than four cells of a level. A pair is
    kept in the one cell that holds the lower left corner of the boxes' overlap.

    Both go through one join, features to the levels that polygons have. Cells
    whose size is measured as ``small`` bytes at most are broadcast, so features
    stay where they are; else a cell with more than ``hot`` features is dealt to
    several keys. Features and polygons without coordinates meet nothing.
    """
    fb, pb, cell = F.col("bbox"), F.col("_pb"), F.col("_cell")
    point = F.coalesce(F.col("geom_type") == "Point", F.lit(False))
    p = polygons.where("bbox.xmin is not null").select("polygon_id", F.col("bbox").alias("_pb"), F.col("edges").alias("_edges"))
    p = p.withColumn("_pl", _level(pb).cast("int"))
    one = F.struct(F.lit(0).alias("base"), F.array().cast("array<double>").alias("turns"), F.col("_edges").alias("edges")).alias("_near")
    whole = p.withColumn("_c", F.explode(_cells(pb, F.sequence(F.lit(0), F.col("_pl"))))).select("polygon_id", _keyed(F.lit(True), F.col("_c")), "_pb", "_pl", one)
    # a polygon of few edges is covered by the cells of its own level
    parts = p.where(F.size("_edges") <= MOST).withColumn("_c", F.explode(_cells(pb, F.array("_pl")))).select("polygon_id", _keyed(F.lit(False), F.col("_c")), "_pb", "_pl", one)
    cells = whole.unionByName(parts)
    # at most four cells of each level with all edges, for boxes and, of the own level, for points
    copies = (F.size("_edges") * 32 + 200).cast("bigint") * 4 * (F.col("_pl") + 2)
    seen = p.agg(F.collect_set("_pl").alias("levels"), F.max(F.size("_edges")).alias("edges"), F.sum(copies).alias("bytes")).first()  # some twenty numbers
    spots, tops = set(seen["levels"]), list(range(max(seen["levels"], default=-1) + 1))
    size = seen["bytes"] or 0
    if (seen["edges"] or 0) > MOST:
        near = F.struct("_c.base", "_c.turns", "_c.edges").alias("_near")
        large = p.where(F.size("_edges") > MOST).withColumn("_c", F.explode(cover_cells(F.col("_edges"))))
        covers = staged(large.select("polygon_id", _keyed(F.lit(False), F.col("_c")), "_pb", "_pl", near), "cover")  # worked out once
        each = F.size("_near.edges").cast("bigint") * 32 + F.size("_near.turns") * 8 + 200
        made = covers.agg(F.collect_set("_cell.level").alias("levels"), F.sum(each).alias("bytes")).first()
        spots, size = spots | set(made["levels"]), size + (made["bytes"] or 0)
        cells = cells.unionByName(covers)

    def these(values: list[int]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<int>")

    own = F.col("_fl")
    # a box goes to the coarser levels and to its own, unless no polygon is as fine
    coarser = F.filter(these(tops), lambda k: k < own)
    here = F.when(own <= max(tops, default=-1), F.concat(coarser, F.array(own))).otherwise(coarser)
    spot = F.get(F.get(F.get(F.col("coords"), 0), 0), 0)
    x, y = F.get(spot, 0), F.get(spot, 1)
    dot = F.transform(these(sorted(spots)), lambda k: F.struct(k.alias("level"), _cell(x, k).alias("x"), _cell(y, k).alias("y")))
    f = features.where("bbox.xmin is not null").withColumn("_fl", _level(fb).cast("int")).withColumn("_c", F.explode(F.when(point, dot).otherwise(_cells(fb, here))))
    f = f.withColumn("_cell", _keyed(~point, F.col("_c"))).drop("_c")
    keys = ["_cell"]
    if size <= small:
        cells = F.broadcast(cells)
    else:
        f, cells = _salted(f, cells, hot)
        keys.append("_salt")

    overlap = (fb["xmin"] <= pb["xmax"]) & (fb["xmax"] >= pb["xmin"]) & (fb["ymin"] <= pb["ymax"]) & (fb["ymax"] >= pb["ymin"])
    corner = (_cell(F.greatest(fb["xmin"], pb["xmin"]), cell["level"]) == cell["x"]) & (_cell(F.greatest(fb["ymin"], pb["ymin"]), cell["level"]) == cell["y"])
    near = overlap & (point | (corner & (cell["level"] == F.least("_fl", "_pl"))))
    met = F.when(~near, False).when(point, in_cell(x, y, F.col("_near"))).otherwise(G.intersects(F.col("coords"), F.col("geom_type"), F.col("_near.edges")))
    pairs = f.join(cells, keys).where(near).where(met)
    if how == "left_semi":  # only ids travel to be made distinct
        return features.join(pairs.select("id").distinct(), "id", "left_semi")
    return pairs.select(*features.columns, "polygon_id")


def _keyed(whole: Column, cell: Column) -> Column:
    return F.struct(whole.alias("whole"), cell["level"].cast("int").alias("level"), cell["x"].alias("x"), cell["y"].alias("y")).alias("_cell")
