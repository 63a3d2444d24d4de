"""Scans: feature files, catalogs, sidecars, manifests, item tables and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import listing


def parse_lines(lines: DataFrame) -> DataFrame:
    """``line``, ``feature`` (variant) and ``is_bad`` of text lines; blank lines are bad like any other that isn't JSON."""
    feature = F.try_parse_json("line")
    return lines.withColumn("feature", feature).withColumn("is_bad", feature.isNull())


def read_geojsonl(spark: SparkSession, path: str | list[str], order: str | None = None) -> DataFrame:
    """One feature per line; a line that isn't JSON is kept and marked.

    ``order`` names a column for the lines' order: by the path of their file, and
    within it from the top. Spark deals out files by size and cuts large ones; the
    order doesn't depend on that.
    """
    lines = spark.read.text(path)
    columns = [F.col("value").alias("line")]
    if order:
        # a split is read from its begin on, so numbers of rows rise within it
        split = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
        columns.append(F.struct(*split, F.monotonically_increasing_id().alias("row")).alias(order))
    return parse_lines(lines.select(*columns))


def read_features(spark: SparkSession, path: str | list[str], merge: bool = False) -> DataFrame:
    """GeoParquet files; ``merge`` unites the columns of files that differ."""
    paths = [path] if isinstance(path, str) else list(path)
    with listing(spark):
        return spark.read.option("mergeSchema", str(merge).lower()).parquet(*paths)


def schema_table(df: DataFrame) -> DataFrame:
    """``position``, ``column`` and ``type`` of a table's columns, from its real schema."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


ROUTE = "struct<handlertype: string, category: variant, name: string, url: string, partitioned_parquet: boolean, license: string, notes: string, promoteid: string, type: string, tilesuffix: string, description: string>"


def catalog_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """One row per route of catalog JSON, with the defaults filled in and the categories as a list."""
    routes = text.select(F.map_entries(F.from_json(column, f"map<string, {ROUTE}>")).alias("routes"))
    each = routes.select(F.posexplode("routes").alias("pos", "entry")).select("pos", F.col("entry.key").alias("route"), "entry.value.*")
    many = F.expr("try_variant_get(category, '$', 'array<string>')")
    one = F.array_compact(F.array(F.expr("try_variant_get(category, '$', 'string')")))
    kind = F.coalesce("type", F.lit("vector"))
    return each.select(
        "pos", "route", F.coalesce("name", "route").alias("name"), "handlertype", "url", "license", "notes", "promoteid", "description",
        F.coalesce("partitioned_parquet", F.lit(False)).alias("partitioned_parquet"),
        kind.alias("type"),
        F.coalesce("tilesuffix", F.when(kind == "raster", "webp").otherwise("pbf")).alias("tilesuffix"),
        F.when(F.schema_of_variant("category").startswith("ARRAY"), many).otherwise(one).alias("_c"),
    ).withColumn("categories", F.coalesce("_c", F.array().cast("array<string>"))).drop("_c")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_rows(spark.read.text(path, wholetext=True))


def extents_rows(text: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``part`` and its box of sidecar JSON, and the columns to keep; extents are objects or lists, and a box with a number that isn't finite is null."""
    found = text.select(*keep, F.explode(F.from_json(F.get_json_object(column, "$.extents"), "map<string, string>", {"allowNonNumericNumbers": "true"})).alias("part", "box"))
    names = ("minx", "miny", "maxx", "maxy")
    as_object = [F.get_json_object("box", f"$.{n}").try_cast("double") for n in names]
    as_list = [F.get_json_object("box", f"$[{i}]").try_cast("double") for i in range(4)]
    values = [F.coalesce(a, b) for a, b in zip(as_object, as_list)]
    finite = F.lit(True)
    for v in values:
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return found.select(*keep, "part", *[F.when(finite, v).alias(n) for n, v in zip(names, values)])


def read_extents(spark: SparkSession, path: str) -> DataFrame:
    return extents_rows(spark.read.text(path, wholetext=True))


HEADER = "struct<min_lon_e7: bigint, min_lat_e7: bigint, max_lon_e7: bigint, max_lat_e7: bigint, min_zoom: int, max_zoom: int>"


def mosaic_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """Slices of mosaic manifests, in manifest order; other versions than 1 are refused."""
    parsed = text.select(F.from_json(column, f"struct<version: int, slices: map<string, struct<header: {HEADER}>>>").alias("m"))
    parsed = parsed.select(F.when(F.col("m.version") == 1, F.col("m.slices")).otherwise(F.raise_error(F.lit("unsupported mosaic version")).cast(f"map<string, struct<header: {HEADER}>>")).alias("slices"))
    each = parsed.select(F.posexplode(F.map_entries("slices")).alias("slice_pos", "entry"))
    return each.select("slice_pos", F.col("entry.key").alias("slice"), "entry.value.header.*")


def read_mosaic(spark: SparkSession, path: str) -> DataFrame:
    return mosaic_rows(spark.read.text(path, wholetext=True))


def slices_by_zoom(slices: DataFrame) -> DataFrame:
    """One row per slice and zoom: an equality key for tile look-ups."""
    return slices.withColumn("z", F.explode(F.sequence("min_zoom", "max_zoom")))


def read_schemas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file_pos``, ``position``, ``column`` and ``type`` of the columns of Parquet files, from their footers."""
    rows = [(n, i, f.name, f.dataType.simpleString()) for n, path in enumerate(paths) for i, f in enumerate(spark.read.parquet(path).schema.fields)]
    return spark.createDataFrame(rows, "file_pos int, position int, column string, type string")


#: Columns of an item table, by position.
ITEM_COLUMNS = ("id", "assets", "bbox", "geometry", "links", "stac_extensions", "version", "type", "datetime", "proj_epsg", "proj_shape", "proj_transform")


def stac_items(table: DataFrame, collection: str, pos: str = "pos") -> DataFrame:
    """Items from the columns of an item table; the geometry is the box as a ring. An empty id or version counts as missing."""
    b = F.col("bbox")
    corner = lambda x, y: F.array(b[x], b[y])
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    return table.select(
        F.col(pos).alias("item_pos"),
        F.lit(collection).alias("collection"),
        F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("item-"), F.col(pos).cast("string"))).alias("id"),
        F.coalesce(F.nullif("version", F.lit("")), F.lit("1.0.0")).alias("stac_version"),
        F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"]).alias("bbox"),
        F.array(ring).alias("ring"),
        *[c for c in ("datetime", "assets", "stac_extensions", "proj_epsg", "proj_shape", "proj_transform") if c in table.columns],
    )


def read_stac_items(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Items of a Parquet table, whose columns are known by their position; rows are numbered in the order of files by path, and within each from the top."""
    with listing(spark):
        raw = spark.read.parquet(path)
    if len(raw.columns) < len(ITEM_COLUMNS):
        raise ValueError(f"an item table has the columns {', '.join(ITEM_COLUMNS)}, in this order: {path}")
    named = [F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, ITEM_COLUMNS)]
    rows = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("pos"), *named)
    # rows of the files before: a row a file
    sizes = raw.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select("_file", before.alias("_before"))), "_file")
    return stac_items(rows.withColumn("pos", F.col("pos") + F.col("_before")), collection)


def asset_rows(lines: DataFrame) -> DataFrame:
    """``repo``, ``tag`` and ``asset`` from listing lines and their file's path; blank lines are dropped."""
    pattern = r"/([^/]+)/([^/]+)/files\.txt$"
    return lines.select(
        F.regexp_extract("path", pattern, 1).alias("repo"),
        F.regexp_extract("path", pattern, 2).alias("tag"),
        F.trim("value").alias("asset"),
    ).where("asset <> ''")


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    return asset_rows(spark.read.text(f"{root}/*/*/files.txt").select("value", F.col("_metadata.file_path").alias("path")))


def filter_layer_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """Polygons of a feature collection, numbered from 0 after other types are dropped."""
    kind = "array<struct<geometry: string, properties: map<string, string>>>"
    features = F.from_json(F.get_json_object(column, "$.features"), kind)
    polygonal = F.filter(features, lambda f: F.get_json_object(f["geometry"], "$.type").isin("Polygon", "MultiPolygon"))
    return text.select(F.posexplode(polygonal).alias("pos", "f")).select("pos", "f.geometry", "f.properties")


def read_filter_layer(spark: SparkSession, path: str) -> DataFrame:
    return filter_layer_rows(spark.read.text(path, wholetext=True))


def collection_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """Collections of a STAC catalog: its child links that name a GeoParquet file."""
    links = F.from_json(F.get_json_object(column, "$.links"), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    each = text.select(F.posexplode(links).alias("pos", "link")).where("link['rel'] = 'child' and link['geoparquet'] is not null")
    name = F.regexp_replace(F.regexp_replace(F.col("link")["href"], r"^\./", ""), "/$", "")
    return each.select("pos", name.alias("id"), F.coalesce(F.col("link")["title"], name).alias("title"), F.col("link")["geoparquet"].alias("geoparquet"))


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    return collection_rows(spark.read.text(path, wholetext=True))
