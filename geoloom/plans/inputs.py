"""Map data derived from the standard tables by integer arithmetic.

The expressions are SQL that Spark and DuckDB read alike, so that queries and
their oracles share inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

POINT_COLUMNS = (
    "o_orderkey AS id",
    "o_orderstatus AS status",
    "o_totalprice AS price",
    "CAST(67 AS DOUBLE) + CAST(o_orderkey * 7919 % 31000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon",
    "CAST(5 AS DOUBLE) + CAST(o_orderkey * 104729 % 33000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat",
)
POINTS = f"(SELECT {', '.join(POINT_COLUMNS)} FROM orders)"

_LON = "(CAST(67 AS DOUBLE) + CAST((l_orderkey * 7919 + l_linenumber) % 31000 AS DOUBLE) / CAST(1000 AS DOUBLE))"
_LAT = "(CAST(5 AS DOUBLE) + CAST((l_orderkey * 104729 + l_linenumber) % 33000 AS DOUBLE) / CAST(1000 AS DOUBLE))"
_KIND = "CAST((l_orderkey + l_linenumber) % 8 AS INT)"
DIRTY_COLUMNS = (
    "l_orderkey AS id",
    "l_linenumber AS line_number",
    f"{_KIND} AS kind",
    f"CASE {_KIND} WHEN 1 THEN {_LAT} WHEN 2 THEN {_LON} * 10 WHEN 3 THEN {_LAT} WHEN 4 THEN CAST(50 AS DOUBLE) WHEN 5 THEN CAST(0 AS DOUBLE) ELSE {_LON} END AS lon",
    f"CASE {_KIND} WHEN 1 THEN {_LON} WHEN 3 THEN {_LON} * 10 WHEN 4 THEN CAST(50 AS DOUBLE) WHEN 5 THEN CAST(200 AS DOUBLE) ELSE {_LAT} END AS lat",
)
DIRTY = f"(SELECT {', '.join(DIRTY_COLUMNS)} FROM lineitem)"

POLYGON_COLUMNS = (
    "n_nationkey AS polygon_id",
    "n_name AS name",
    "n_nationkey % 2 = 1 AS triangle",
    "CAST(67.0005 AS DOUBLE) + CAST(6 * (n_nationkey % 5) AS DOUBLE) AS x0",
    "CAST(5.0002 AS DOUBLE) + CAST(n_nationkey - n_nationkey % 5 AS DOUBLE) / CAST(5 AS DOUBLE) * CAST(6 AS DOUBLE) AS y0",
)
POLYGONS = f"(SELECT {', '.join(POLYGON_COLUMNS)} FROM nation)"

SLICE_COLUMNS = (
    "s_suppkey AS slice_pos",
    "s_name AS slice",
    "(68 + s_suppkey * 37 % 26) * 10000000 AS min_lon_e7",
    "(6 + s_suppkey * 53 % 28) * 10000000 AS min_lat_e7",
    "(70 + s_suppkey * 37 % 26 + s_suppkey % 4) * 10000000 AS max_lon_e7",
    "(8 + s_suppkey * 53 % 28 + s_suppkey % 3) * 10000000 AS max_lat_e7",
    "CAST(5 + s_suppkey % 3 AS INT) AS min_zoom",
    "CAST(8 + s_suppkey % 3 AS INT) AS max_zoom",
)
SLICES = f"(SELECT {', '.join(SLICE_COLUMNS)} FROM supplier)"

TILE_COLUMNS = (
    "p_partkey AS part",
    "CAST(5 + p_size % 6 AS INT) AS z",
    "CAST(floor(CAST(247 + p_partkey * 7919 % 31 AS DOUBLE) / CAST(360 AS DOUBLE) * pow(2, 5 + p_size % 6)) AS BIGINT) AS x",
    "CAST(floor((CAST(384 + p_partkey * 104729 % 102 AS DOUBLE) / CAST(1000 AS DOUBLE)) * pow(2, 5 + p_size % 6)) AS BIGINT) AS y",
    "CAST(1000 + p_partkey * 31 % 50000 AS BIGINT) AS bytes",
)
TILES = f"(SELECT {', '.join(TILE_COLUMNS)} FROM part)"

CATALOG_COLUMNS = (
    "p_partkey AS pos",
    "CASE WHEN p_partkey % 97 = 0 THEN concat('part-', CAST(p_partkey AS STRING)) ELSE concat('/', lower(replace(p_type, ' ', '-')), '/', CAST(p_partkey AS STRING)) END AS route",
    "p_name AS name",
    "CASE WHEN p_partkey % 5 = 0 THEN 'raster' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'vector' END AS type",
    "CASE WHEN p_partkey % 11 = 0 THEN 'cog' WHEN p_partkey % 3 = 0 THEN 'mosaic' ELSE 'pmtiles' END AS handlertype",
    "concat('https://github.com/org/repo', CAST(p_partkey % 4 AS STRING), '/releases/download/v', CAST(p_size % 3 AS STRING), '/', replace(p_name, ' ', '_'), '-', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '.mosaic.json' ELSE '.pmtiles' END) AS url",
    "CASE WHEN p_partkey % 4 = 0 THEN concat('CC0 ', p_brand) END AS license",
    "CASE WHEN p_partkey % 6 = 0 THEN concat('see [', p_brand, '](https://x.org/', CAST(p_size AS STRING), ') or https://y.org/', CAST(p_partkey AS STRING)) END AS notes",
    "CASE WHEN p_partkey % 10 = 0 THEN 'fid' END AS promoteid",
    "p_partkey % 13 = 0 AS partitioned_parquet",
    "p_brand AS brand",
    "p_type AS ptype",
)
CATALOG = f"(SELECT {', '.join(CATALOG_COLUMNS)} FROM part)".replace("AS STRING", "AS VARCHAR")

#: Listed assets of the catalog's archives.
ASSET_SUFFIXES = {
    "archive": "p_partkey % 2 = 0", ".geojsonl.7z.001": "p_partkey % 8 = 1", ".parquet": "p_partkey % 3 = 1", ".0.parquet": "p_partkey % 9 = 0",
    ".1.parquet": "p_partkey % 18 = 0", ".pmtiles": "p_partkey % 3 <> 0", "-part0001.pmtiles": "p_partkey % 12 = 0", ".mosaic.json": "p_partkey % 3 = 0",
    ".parquet.meta.json": "p_partkey % 27 = 0", ".analysis.json": "p_partkey % 5 = 2", ".txt": "p_partkey % 50 = 0",
}
_BASE = "concat(replace(p_name, ' ', '_'), '-', CAST(p_partkey AS VARCHAR))"
ASSETS = "(" + " UNION ALL ".join(
    f"SELECT concat('org/repo', CAST(p_partkey % 4 AS VARCHAR)) AS repo, concat('v', CAST(p_size % 3 AS VARCHAR)) AS tag, {_BASE} AS base, concat({_BASE}, '{'.geojsonl.7z' if s == 'archive' else s}') AS asset FROM part WHERE {c}" for s, c in ASSET_SUFFIXES.items()
) + ")"

#: Items: two collections of orders.
ITEM_COLUMNS = (
    "o_orderkey AS item_pos",
    "CAST(o_custkey % 2 AS INT) AS collection_pos",
    "concat('c', CAST(o_custkey % 2 AS STRING)) AS collection",
    "CASE WHEN o_orderkey % 10 = 0 THEN concat('item-', CAST(o_orderkey AS STRING)) ELSE concat('order-', CAST(o_orderkey AS STRING)) END AS id",
    "CASE WHEN o_orderkey % 3 = 0 THEN '1.0.0' ELSE '1.1.0' END AS version",
    "CAST(67 + o_orderkey * 7919 % 31 AS DOUBLE) AS w",
    "CAST(5 + o_orderkey * 104729 % 33 AS DOUBLE) AS s",
    "CAST(68 + o_orderkey * 7919 % 31 + o_orderkey % 3 AS DOUBLE) AS e",
    "CAST(6 + o_orderkey * 104729 % 33 + o_orderkey % 2 AS DOUBLE) AS n",
)
ITEMS = f"(SELECT {', '.join(ITEM_COLUMNS)} FROM orders)".replace("AS STRING", "AS VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points, with box and coordinates."""
    df = table(spark, sf_dir, "orders").selectExpr(*POINT_COLUMNS)
    box = F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    return df.withColumn("geom_type", F.lit("Point")).withColumn("coords", G.point_coords(F.col("lon"), F.col("lat"))).withColumn("bbox", box)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points with misplaced coordinates."""
    df = table(spark, sf_dir, "lineitem").selectExpr(*DIRTY_COLUMNS)
    return df.withColumn("geom_type", F.lit("Point")).withColumn("coords", G.point_coords(F.col("lon"), F.col("lat")))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as squares, or triangles where the key is odd."""
    return _with_corners(table(spark, sf_dir, "nation").selectExpr(*POLYGON_COLUMNS), 5)


def _with_corners(df: DataFrame, side: float) -> DataFrame:
    x0, y0 = F.col("x0"), F.col("y0")
    p = lambda x, y: F.array(x, y)
    square = F.array(p(x0, y0), p(x0 + side, y0), p(x0 + side, y0 + side), p(x0, y0 + side), p(x0, y0))
    triangle = F.array(p(x0, y0), p(x0 + side, y0), p(x0, y0 + side), p(x0, y0))
    df = df.withColumn("coords", F.array(F.array(F.when(F.col("triangle"), triangle).otherwise(square)))).withColumn("geom_type", F.lit("Polygon"))
    return df.withColumn("bbox", G.bbox(F.col("coords"))).withColumn("edges", G.edges(F.col("coords")))


#: Parts as small squares, or triangles where the key is odd.
PARCEL_COLUMNS = (
    "p_partkey AS polygon_id",
    "p_name AS name",
    "p_partkey % 2 = 1 AS triangle",
    "CAST(67 AS DOUBLE) + CAST(p_partkey * 7919 % 30000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS x0",
    "CAST(5 AS DOUBLE) + CAST(p_partkey * 104729 % 32000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS y0",
)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as squares or triangles of a quarter of a degree."""
    return _with_corners(table(spark, sf_dir, "part").selectExpr(*PARCEL_COLUMNS), 0.25)


#: Whether a point is in such a polygon, by half planes.
IN_POLYGON = "lon >= x0 AND lat >= y0 AND CASE WHEN triangle THEN (lon - x0) + (lat - y0) <= 5 ELSE lon <= x0 + 5 AND lat <= y0 + 5 END"


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*SLICE_COLUMNS)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*TILE_COLUMNS)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog rows."""
    df = table(spark, sf_dir, "part").selectExpr(*CATALOG_COLUMNS)
    return df.withColumn("categories", F.array("brand", "ptype")).withColumn("description", F.lit(None).cast("string")).withColumn("tilesuffix", F.lit("pbf"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed assets: repo, tag, asset."""
    part = table(spark, sf_dir, "part")
    base = _BASE.replace("AS VARCHAR", "AS STRING")
    names = [F.expr(f"CASE WHEN {c} THEN concat({base}, '{'.geojsonl.7z' if s == 'archive' else s}') END") for s, c in ASSET_SUFFIXES.items()]
    each = part.withColumn("asset", F.explode(F.array_compact(F.array(*names))))
    return each.selectExpr("concat('org/repo', CAST(p_partkey % 4 AS STRING)) AS repo", "concat('v', CAST(p_size % 3 AS STRING)) AS tag", "asset")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of two collections."""
    df = table(spark, sf_dir, "orders").selectExpr(*ITEM_COLUMNS)
    return df.withColumn("bbox", F.array("w", "s", "e", "n"))


#: A polygon that no point of the grid lies on.
TRIANGLE = [[(70.0005, 8.0002), (90.0005, 8.0002), (80.0005, 30.0002), (70.0005, 8.0002)]]
IN_TRIANGLE = (
    "lat >= 8.0002 AND CAST(22 AS DOUBLE) * (lon - CAST(70.0005 AS DOUBLE)) - CAST(10 AS DOUBLE) * (lat - CAST(8.0002 AS DOUBLE)) >= 0"
    " AND CAST(22 AS DOUBLE) * (CAST(90.0005 AS DOUBLE) - lon) - CAST(10 AS DOUBLE) * (lat - CAST(8.0002 AS DOUBLE)) >= 0"
)
