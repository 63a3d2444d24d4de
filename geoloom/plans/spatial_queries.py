"""Queries: partitions, tiles, slices, spatial joins, extents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, partitioning, profiles
from ..sources import readers, sinks
from ..sources.scratch import scratch
from .inputs import IN_POLYGON, IN_TRIANGLE, POINTS, POLYGONS, SLICES, TILES, TRIANGLE, points, polygons, slices, table, tiles
from .registry import Registry
from .scalar_queries import TILE_BOX

REGISTRY = register = Registry()


def _kd_sql(depth: int) -> str:
    """Nodes by medians of alternate axes, exact for fewer rows than the operator's accuracy."""
    sql = f"SELECT *, 0 AS leaf FROM {POINTS}"
    for k in range(depth):
        axis = "lon" if k % 2 == 0 else "lat"
        sql = f"SELECT * REPLACE (leaf * 2 + CASE WHEN {axis} > quantile_disc({axis}, 0.5) OVER (PARTITION BY leaf) THEN 1 ELSE 0 END AS leaf) FROM ({sql})"
    return sql


KD = _kd_sql(4)


@register(f"SELECT id, CAST(leaf AS INT) AS kd_leaf FROM ({KD})")
def p01_kd_partition(spark, sf_dir):
    return partitioning.kd_partition(points(spark, sf_dir), 16).select("id", "kd_leaf")


@register("SELECT o_orderkey AS id, CAST(CASE WHEN s <= 2147483648 THEN 1 ELSE pow(2, ceil(log2(ceil(s / 2147483648.0)))) END AS BIGINT) AS parts FROM (SELECT o_orderkey, o_orderkey * 1000003 AS s FROM orders)")
def p02_partition_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), partitioning.partition_count(F.col("o_orderkey") * 1000003).alias("parts"))


@register(f"SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, true AS several, CAST(0 AS BIGINT) AS oversized FROM {POINTS}")
def p02_write_bounded(spark, sf_dir):
    """A limit that the whole table passes by far."""
    path = scratch(spark, "bounded")
    most = 20_000
    leaves = partitioning.write_bounded(points(spark, sf_dir).select("id", "bbox"), path, most)
    stored = readers.read_features(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    return stored.select("n", "ids", F.lit(leaves > 1).alias("several"), F.lit(partitioning.oversized(spark, path, most).count()).cast("bigint").alias("oversized"))


@register(f"SELECT id FROM {POINTS}")
def p02_hot_point(spark, sf_dir):
    """All points at one place: leaves are cut by the number of the row."""
    path = scratch(spark, "hot")
    most = 60_000
    here = F.struct(*[F.lit(v).alias(c) for v, c in ((77.0, "xmin"), (12.0, "ymin"), (77.0, "xmax"), (12.0, "ymax"))])
    partitioning.write_bounded(points(spark, sf_dir).select("id").withColumn("bbox", here), path, most)
    large = partitioning.oversized(spark, path, most)
    return readers.read_features(spark, path).select("id").join(large.limit(1), how="left_anti", on=F.lit(True))


@register(f"SELECT CAST(leaf AS INT) AS kd_leaf, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM ({KD}) GROUP BY leaf")
def a06_partition_extents(spark, sf_dir):
    return profiles.partition_extents(partitioning.kd_partition(points(spark, sf_dir), 16))


@register("""WITH first AS (SELECT DISTINCT o_orderpriority AS c FROM orders WHERE o_orderkey % 2 = 0), second AS (SELECT DISTINCT o_orderpriority AS c FROM orders UNION SELECT DISTINCT o_orderstatus FROM orders)
SELECT 'day' AS "column", 'int' AS type UNION ALL SELECT c, 'bigint' FROM first UNION ALL SELECT c, 'double' FROM second WHERE c NOT IN (SELECT c FROM first)""")
def a07_schema_union(spark, sf_dir):
    """Two files whose columns are values of the table: counts by priority, then prices by priority and status."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.dayofmonth("o_orderdate"))
    paths = [scratch(spark, "schema-a"), scratch(spark, "schema-b")]
    o.where("o_orderkey % 2 = 0").groupBy("day").pivot("o_orderpriority").count().write.parquet(paths[0])
    both = o.select("day", "o_totalprice", F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("value"))
    both.groupBy("day").pivot("value").agg(F.sum("o_totalprice")).write.parquet(paths[1])
    return profiles.schema_union(readers.read_schemas(spark, paths)).select("column", "type")


@register("SELECT s_nationkey AS nation, CASE WHEN bool_or(s_suppkey % 2 = 0) AND bool_or(s_suppkey % 2 = 1) THEN 'MultiPolygon,Point,Polygon' WHEN bool_or(s_suppkey % 2 = 0) THEN 'MultiPolygon,Polygon' ELSE 'Point' END AS types FROM supplier GROUP BY s_nationkey")
def a08_geometry_type_union(spark, sf_dir):
    types = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("Polygon"), F.lit("MultiPolygon"))).otherwise(F.array(F.lit("Point")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), types.alias("types"))
    return profiles.geometry_type_union(rows, ["nation"]).select("nation", F.array_join("types", ",").alias("types"))


@register(f"SELECT min_zoom, min(min_lon_e7) AS minx, min(min_lat_e7) AS miny, max(max_lon_e7) AS maxx, max(max_lat_e7) AS maxy FROM {SLICES} GROUP BY min_zoom")
def a12_bounds(spark, sf_dir):
    box = F.struct(F.col("min_lon_e7").alias("xmin"), F.col("min_lat_e7").alias("ymin"), F.col("max_lon_e7").alias("xmax"), F.col("max_lat_e7").alias("ymax"))
    return profiles.bounds_of(slices(spark, sf_dir).withColumn("bbox", box), ["min_zoom"])


@register(f"SELECT id FROM {POINTS} WHERE {IN_TRIANGLE}")
def j01_prune_partitions(spark, sf_dir):
    """Write leaves, prune them by the polygon, then test exactly: equal to the unpruned result."""
    from ..operators.filters import shape_filter

    path = scratch(spark, "leaves")
    partitioning.write_partitioned(partitioning.kd_partition(points(spark, sf_dir), 16), path)
    stored = readers.read_features(spark, path)
    extents = profiles.partition_extents(stored)
    return shape_filter(joins.prune_partitions(stored, extents, TRIANGLE), TRIANGLE).select("id")


@register(f"SELECT slice_pos FROM (SELECT *, slice_pos % 9 = 0 AS unknown FROM {SLICES}) WHERE unknown OR (min_lon_e7 <= 80 * 1e7 AND max_lon_e7 >= 75 * 1e7 AND min_lat_e7 <= 20 * 1e7 AND max_lat_e7 >= 12 * 1e7)")
def j02_prune_files(spark, sf_dir):
    known = F.col("slice_pos") % 9 != 0
    rows = slices(spark, sf_dir).select("slice_pos", *[F.when(known, F.col(c) / 1e7).alias(n) for c, n in (("min_lon_e7", "minx"), ("min_lat_e7", "miny"), ("max_lon_e7", "maxx"), ("max_lat_e7", "maxy"))])
    return joins.prune_files(rows, (75, 12, 80, 20)).select("slice_pos")


_MATCH = """SELECT z, x, y, slice FROM (SELECT t.z, t.x, t.y, s.slice, row_number() OVER (PARTITION BY t.z, t.x, t.y ORDER BY s.slice_pos) AS r
FROM (SELECT DISTINCT z, x, y, {box} FROM {tiles}) t JOIN {slices} s ON t.z BETWEEN s.min_zoom AND s.max_zoom AND t.s <= s.max_lat_e7 AND t.n >= s.min_lat_e7 AND {lon}) WHERE r = 1"""


@register(_MATCH.format(box=TILE_BOX, tiles=TILES, slices=SLICES, lon="t.e <= s.max_lon_e7 AND t.w >= s.min_lon_e7"))
def j03_tile_to_slice(spark, sf_dir):
    return joins.tile_to_slice(tiles(spark, sf_dir), slices(spark, sf_dir))


@register(_MATCH.format(box=TILE_BOX, tiles=TILES, slices=SLICES, lon="t.w <= s.max_lon_e7 AND t.e >= s.min_lon_e7"))
def j03_tile_to_slice_symmetric(spark, sf_dir):
    return joins.tile_to_slice(tiles(spark, sf_dir), slices(spark, sf_dir), symmetric=True)


@register(f"SELECT f.id, p.polygon_id FROM {POINTS} f, {POLYGONS} p WHERE {IN_POLYGON}")
def j04_spatial_join(spark, sf_dir):
    return joins.spatial_join(points(spark, sf_dir), polygons(spark, sf_dir)).select("id", "polygon_id")


@register(f"SELECT f.id FROM {POINTS} f WHERE EXISTS (SELECT 1 FROM {POLYGONS} p WHERE {IN_POLYGON})")
def j04_spatial_semi_join(spark, sf_dir):
    return joins.spatial_join(points(spark, sf_dir), polygons(spark, sf_dir), how="left_semi").select("id")


@register("SELECT p_brand AS brand, min(p_partkey) AS first_part, arg_min(p_name, p_partkey) AS name FROM part GROUP BY p_brand")
def w02_first_match(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_brand AS brand", "p_partkey AS first_part", "p_name AS name")
    return joins.first_match(rows, ["brand"], "first_part")


_N = "pow(2, z)"
TILED = f"""SELECT id, z, CAST(floor((lon + 180) / 360 * {_N}) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {_N}) AS BIGINT) AS y
FROM {POINTS}, (SELECT unnest([4, 6, 8]) AS z)"""


@register(f"SELECT z, x, y, count(*) AS features FROM ({TILED}) GROUP BY z, x, y")
def p03_tile_counts(spark, sf_dir):
    return partitioning.tile_counts(partitioning.tile_assign(points(spark, sf_dir), [4, 6, 8]))


@register(f"SELECT z, x, y, CAST(least(count(*), 3) AS BIGINT) AS features FROM ({TILED}) GROUP BY z, x, y")
def p03_thinned_counts(spark, sf_dir):
    tiled = partitioning.tile_assign(points(spark, sf_dir), [4, 6, 8])
    return partitioning.tile_counts(partitioning.thin_tiles(tiled, 3))


@register(f"SELECT z, x, y, count(*) AS features FROM (SELECT id, z, CAST(floor((lon + 180) / 360 * {_N}) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {_N}) AS BIGINT) AS y FROM {POINTS}, (SELECT unnest(generate_series(5, 9)) AS z)) GROUP BY z, x, y")
def p03_tile_pyramid(spark, sf_dir):
    """Counts of all zooms from those of the finest."""
    return partitioning.pyramid_counts(partitioning.tile_pyramid(points(spark, sf_dir), 9, 5), list(range(5, 10)))


_TILE_X = "CAST(floor(({lon} + 180) / 360 * pow(2, 7)) AS BIGINT)"
_TILE_Y = "CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2, 7)) AS BIGINT)"


@register(f"""SELECT x, y, count(*) AS polygons FROM (SELECT polygon_id, unnest(generate_series(x_from, x_to)) AS x, y_from, y_to FROM (SELECT polygon_id,
{_TILE_X.format(lon='x0')} AS x_from, {_TILE_X.format(lon='(x0 + 5)')} AS x_to, {_TILE_Y.format(lat='(y0 + 5)')} AS y_from, {_TILE_Y.format(lat='y0')} AS y_to FROM {POLYGONS})) t, generate_series(0, 127) g(y)
WHERE y BETWEEN y_from AND y_to GROUP BY x, y""")
def p03_polygon_tiles(spark, sf_dir):
    """Tiles that polygons' boxes cover, from tiles that stay whole where the box covers them."""
    pyramid = partitioning.tile_pyramid(polygons(spark, sf_dir), 7, 7)
    return partitioning.pyramid_counts(pyramid, [7]).select("x", "y", F.col("features").alias("polygons"))


@register(f"SELECT z, x, y, true AS fits FROM ({TILED}) GROUP BY z, x, y")
def p03_fit_tiles(spark, sf_dir):
    """Tiles from which the densest features are dropped until 40 of 100 bytes each fit: none is empty, none larger."""
    spaced = partitioning.spacing(points(spark, sf_dir)).withColumn("bytes", F.lit(100))
    kept = partitioning.fit_tiles(partitioning.tile_assign(spaced, [4, 6, 8]), 4_000)
    return kept.groupBy("z", "x", "y").agg((F.sum("bytes") <= 4_000).alias("fits"))


#: Tiles one after another, each in the shard before unless that would pass the limit.
PACKED = f"""(WITH RECURSIVE t AS (
    SELECT row_number() OVER (ORDER BY z, x, y) AS r, * FROM (SELECT z, x, y, CAST(sum(bytes) AS BIGINT) AS bytes FROM {TILES} GROUP BY z, x, y)
), packed AS (
    SELECT t.*, bytes AS used, CAST(0 AS BIGINT) AS shard FROM t WHERE r = 1
    UNION ALL
    SELECT t.*, CASE WHEN p.used + t.bytes > 1000000 THEN t.bytes ELSE p.used + t.bytes END, p.shard + CASE WHEN p.used + t.bytes > 1000000 THEN 1 ELSE 0 END FROM packed p JOIN t ON t.r = p.r + 1
) SELECT * FROM packed)"""


def _sized_tiles(spark, sf_dir):
    return tiles(spark, sf_dir).groupBy("z", "x", "y").agg(F.sum("bytes").alias("bytes"))


@register(f"SELECT z, x, y, shard FROM {PACKED}")
def p04_pack_shards(spark, sf_dir):
    return partitioning.pack_shards(_sized_tiles(spark, sf_dir), 1_000_000).select("z", "x", "y", "shard")


@register(f"SELECT shard, min(w) AS min_lon_e7, min(s) AS min_lat_e7, max(e) AS max_lon_e7, max(n) AS max_lat_e7, min(z) AS min_zoom, max(z) AS max_zoom, count(*) AS tiles FROM (SELECT *, {TILE_BOX} FROM {PACKED}) GROUP BY shard")
def p04_shard_manifest(spark, sf_dir):
    return partitioning.shard_manifest(partitioning.pack_shards(_sized_tiles(spark, sf_dir), 1_000_000))


@register(f"SELECT CAST(leaf AS INT) AS kd_leaf, count(*) AS n FROM ({KD}) WHERE {IN_TRIANGLE} GROUP BY leaf")
def prepare_and_extract(spark, sf_dir):
    """Partition, write, read back with pruning and count: the publishing path end to end."""
    from ..operators.filters import shape_filter

    path = scratch(spark, "published")
    parted = partitioning.kd_partition(points(spark, sf_dir), 16)
    sinks.write_geoparquet(parted.select("id", "kd_leaf", "geom_type", "coords", "bbox"), path, sort=["kd_leaf", "bbox.xmin"])
    stored = readers.read_features(spark, path)
    return shape_filter(stored, TRIANGLE).groupBy("kd_leaf").agg(F.count(F.lit(1)).alias("n"))
