"""Sinks: GeoParquet, CSV, GeoJSON, sidecars and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curve import curve
from ..functions.geometry import wkt


def write_geoparquet(df: DataFrame, path: str, level: int = 15, rows: int = 100_000, sort: list[str] | None = None, box: str = "bbox") -> None:
    """Zstandard Parquet in bounded row groups, whose box columns prune.

    Rows with a box are dealt to files, and ordered in them, along a Hilbert
    curve, so that a query's box meets few files and row groups in either axis;
    rows at one place are spread over files too. ``sort`` names other columns
    to order by, within the partitions as they are.
    """
    if sort:
        df = df.sortWithinPartitions(*sort)
    elif box in df.columns:
        keys = ["_curve", "_row"]
        placed = df.withColumn("_curve", curve(F.col(box))).withColumn("_row", F.monotonically_increasing_id())
        df = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": level, "parquet.block.row.count.limit": rows}
    df.write.options(**options).mode("overwrite").parquet(path)


def with_wkt(df: DataFrame, coords: str = "coords", kind: str = "geom_type") -> DataFrame:
    """Geometry columns replaced by a trailing ``wkt``."""
    text = wkt(F.col(coords), F.col(kind))
    return df.withColumn("wkt", text).drop(coords, kind, "geometry", "bbox")


def write_csv_wkt(df: DataFrame, path: str, coords: str = "coords", kind: str = "geom_type") -> None:
    with_wkt(df, coords, kind).write.mode("overwrite").csv(path, header=True)


def feature_line(geometry: str = "geometry", properties: list[str] | None = None) -> Column:
    """A row as a GeoJSON feature; ``geometry`` is GeoJSON text, null properties are kept."""
    inner = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), inner, F.lit("}"))


def geometry_json(coords: str = "coords", kind: str = "geom_type") -> Column:
    """GeoJSON text of depth-4 coordinates."""
    c, k = F.col(coords), F.col(kind)
    inner = (
        F.when(k == "Point", F.to_json(F.get(F.get(F.get(c, 0), 0), 0)))
        .when(k.isin("MultiPoint", "LineString"), F.to_json(F.get(F.get(c, 0), 0)))
        .when(k.isin("Polygon", "MultiLineString"), F.to_json(F.get(c, 0)))
        .otherwise(F.to_json(c))
    )
    return F.concat(F.lit('{"type":"'), k, F.lit('","coordinates":'), inner, F.lit("}"))


def write_geojsonseq(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """One feature per line."""
    properties = [c for c in df.columns if c != geometry]
    df.select(feature_line(geometry, properties).alias("value")).write.mode("overwrite").text(path)


#: Bytes of a shard up to which a collection is written as it is asked for; larger ones become several.
SHARD_BYTES = 32 * 1024**2


def write_geojson(df: DataFrame, path: str, shards: int, geometry: str = "geometry", most: int = SHARD_BYTES) -> None:
    """One valid feature collection per shard: a header, the features and a footer, a line each.

    There are ``shards`` of them, or as many as it takes that a shard has some
    ``most`` bytes: a reader takes a collection whole, so its size must not grow
    with the table.
    """
    properties = [c for c in df.columns if c != geometry]
    lines = df.select(feature_line(geometry, properties).alias("value"))
    size = lines.agg(F.sum(F.octet_length("value").cast("bigint") + 2)).first()[0] or 0
    shards = max(shards, -(-size // most))

    def collections(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": ['{"type":"FeatureCollection","features":[']})
        first = True
        for batch in batches:
            values = [v if first and i == 0 else "," + v for i, v in enumerate(batch.column("value").to_pylist())]
            first = first and not values
            yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    lines.repartition(shards).mapInArrow(collections, "value string").write.mode("overwrite").text(path)


def meta_json(schema: DataFrame, types: DataFrame, extents: DataFrame) -> DataFrame:
    """A sidecar in one row: column types, geometry types and extents by part."""
    columns = schema.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("position", "column", "type"))), lambda s: F.struct(s["column"], s["type"]))).alias("schema"))
    kinds = types.agg(F.array_sort(F.collect_set("geom_type")).alias("geometry_types"))
    boxes = extents.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("part").cast("string"), F.struct("minx", "miny", "maxx", "maxy"))))).alias("extents"))
    one = [d.withColumn("_k", F.lit(1)) for d in (columns, kinds, boxes)]
    return one[0].join(one[1], "_k").join(one[2], "_k").select(F.to_json(F.struct("schema", "geometry_types", "extents")).alias("value"))


def write_meta(schema: DataFrame, types: DataFrame, extents: DataFrame, path: str) -> None:
    meta_json(schema, types, extents).write.mode("overwrite").text(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Column profiles, a folder for each repo and tag."""
    profiles.write.mode("overwrite").partitionBy("repo", "tag").json(path)
