"""Queries that write files and read them back, or run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import partitioning, profiles
from ..sources import readers, sinks
from ..sources.scratch import scratch
from ..streaming import features as stream
from .feature_queries import PROFILE, _event_lines, _profiled
from .inputs import ASSETS, IN_TRIANGLE, ITEMS, POINTS, SLICES, TRIANGLE, assets, items, parcels, points, slices, table
from .registry import Registry

REGISTRY = register = Registry()


def _point_lines(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("id", sinks.feature_line(sinks.geometry_json(), ["id", "status"]).alias("value"))


@register("SELECT CAST(count(*) FILTER (WHERE event_id % 13 = 0) AS BIGINT) AS unparsed, count(*) AS n, CAST(sum(CASE WHEN event_id % 13 <> 0 THEN event_id END) AS BIGINT) AS ids FROM events")
def src01_read_geojsonl(spark, sf_dir):
    path = scratch(spark, "lines")
    _event_lines(spark, sf_dir).select("line").write.text(path)
    rows = readers.read_geojsonl(spark, path)
    whole = F.expr("try_variant_get(feature, '$.properties.whole', 'bigint')")
    return rows.agg(F.count_if("is_bad").alias("unparsed"), F.count(F.lit(1)).alias("n"), F.sum(whole).alias("ids"))


def _written(spark, sf_dir):
    """Points as GeoParquet with well-known bytes, a file for each status."""
    root = scratch(spark, "geoparquet")
    paths = {}
    statuses = sorted((r["status"] for r in points(spark, sf_dir).select("status").distinct().collect()), key=str)  # few
    for i, status in enumerate(statuses):
        paths[status] = f"{root}/{i}"
        rows = points(spark, sf_dir).where(F.col("status").eqNullSafe(F.lit(status))).withColumn("geometry", G.to_wkb("coords", "geom_type"))
        sinks.write_geoparquet(rows.select("id", "status", "geometry", "bbox"), paths[status])
    return paths


@register(f"SELECT id, lon, lat FROM {POINTS} WHERE status = 'F'")
def src02_read_features(spark, sf_dir):
    rows = readers.read_features(spark, _written(spark, sf_dir)["F"]).withColumn("c", G.from_wkb("geometry"))
    p = F.get(F.get(F.get("c", 0), 0), 0)
    return rows.select("id", F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat"))


@register(f"SELECT status, count(*) AS n FROM {POINTS} WHERE status IN ('F', 'P') GROUP BY status")
def src03_read_many(spark, sf_dir):
    paths = _written(spark, sf_dir)
    return readers.read_features(spark, [paths[s] for s in ("F", "P") if s in paths]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT 0 AS position, 'segment' AS "column", 'string' AS type UNION ALL SELECT CAST(row_number() OVER (ORDER BY k) AS INT), CAST(k AS VARCHAR), 'struct<customers:bigint,balance:double>' FROM (SELECT DISTINCT c_nationkey AS k FROM customer)""")
def src04_schema_table(spark, sf_dir):
    """A file with a nested column for each nation that has customers."""
    path = scratch(spark, "schema")
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment")
    pair = F.struct(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance"))
    c.groupBy("segment").pivot("c_nationkey").agg(pair).write.parquet(path)
    return readers.schema_table(readers.read_features(spark, path))


@register("SELECT CAST(s_suppkey AS VARCHAR) AS part, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS minx, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal + 1 END AS maxx FROM supplier")
def src06_read_extents(spark, sf_dir):
    box = F.expr("CASE WHEN s_suppkey % 5 = 0 THEN '[1,2,\"NaN\",4]' WHEN s_suppkey % 2 = 0 THEN concat('[', s_acctbal, ',0,', s_acctbal + 1, ',1]') ELSE concat('{\"minx\":', s_acctbal, ',\"miny\":0,\"maxx\":', s_acctbal + 1, ',\"maxy\":1}') END")
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("d"), F.concat(F.lit('"'), F.col("s_suppkey").cast("string"), F.lit('":'), box).alias("e"))
    text = rows.groupBy("d").agg(F.concat(F.lit('{"extents":{'), F.array_join(F.collect_list("e"), ","), F.lit("}}")).alias("value"))
    path = scratch(spark, "sidecars")
    text.select("value").write.text(path)
    return readers.extents_rows(spark.read.text(path)).select("part", "minx", "maxx")


@register(f"SELECT slice, z, min_lon_e7, max_lat_e7 FROM (SELECT *, CAST(unnest(generate_series(min_zoom, max_zoom)) AS INT) AS z FROM {SLICES})")
def src07_read_mosaic(spark, sf_dir):
    s = slices(spark, sf_dir)
    header = F.struct("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7", "min_zoom", "max_zoom")
    entry = F.struct(F.col("slice"), F.struct(header.alias("header")))
    text = s.groupBy((F.col("slice_pos") % 4).alias("m")).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.collect_list(entry)).alias("slices"))).alias("value"))
    path = scratch(spark, "mosaics")
    text.select("value").write.text(path)
    return readers.slices_by_zoom(readers.mosaic_rows(spark.read.text(path))).select("slice", "z", "min_lon_e7", "max_lat_e7")


@register(f"SELECT repo, tag, asset FROM {ASSETS}")
def src09_read_assets(spark, sf_dir):
    path = scratch(spark, "listings")
    assets(spark, sf_dir).select("asset", F.replace("repo", F.lit("org/"), F.lit("")).alias("r"), F.col("tag").alias("t")).write.partitionBy("r", "t").text(path)
    found = spark.read.text(f"{path}/*/*").select("value", F.regexp_replace(F.col("_metadata.file_path"), r"/r=([^/]+)/t=([^/]+)/[^/]+$", "/$1/$2/files.txt").alias("path"))
    return readers.asset_rows(found).select(F.concat(F.lit("org/"), "repo").alias("repo"), "tag", "asset")


@register("SELECT CAST(row_number() OVER (PARTITION BY p_partkey // 64 ORDER BY p_partkey) - 1 AS INT) AS pos, p_partkey AS part FROM part WHERE p_partkey % 4 <> 0")
def src10_read_filter_layer(spark, sf_dir):
    """A layer for every 64 parts."""
    p = parcels(spark, sf_dir)
    geometry = F.when(F.col("polygon_id") % 4 == 0, F.lit('{"type":"Point","coordinates":[1,2]}')).otherwise(sinks.geometry_json())
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":{"part":'), F.col("polygon_id").cast("string"), F.lit("}}"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("polygon_id", feature.alias("f")))), lambda s: s["f"])
    path = scratch(spark, "layer")
    layers = p.groupBy(F.floor(F.col("polygon_id") / 64).alias("layer")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}")).alias("value"))
    layers.select("value").write.text(path)
    return readers.filter_layer_rows(spark.read.text(path)).select("pos", F.col("properties")["part"].cast("bigint").alias("part"))


@register(f"SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, count(DISTINCT status) AS files FROM {POINTS}")
def snk01_write_geoparquet(spark, sf_dir):
    rows = readers.read_features(spark, list(_written(spark, sf_dir).values()))
    rows = rows.select("id", F.regexp_extract(F.col("_metadata.file_path"), "/([0-9]+)/[^/]+$", 1).alias("file"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.countDistinct("file").alias("files"))


@register(f"SELECT id, status, lon, lat FROM {POINTS}")
def snk02_write_csv_wkt(spark, sf_dir):
    path = scratch(spark, "csv")
    sinks.write_csv_wkt(points(spark, sf_dir).select("id", "status", "geom_type", "coords", "bbox"), path)
    rows = spark.read.csv(path, header=True, schema="id bigint, status string, wkt string")
    n = lambda i: F.regexp_extract("wkt", r"POINT \((\S+) (\S+)\)", i).cast("double")
    return rows.select("id", "status", n(1).alias("lon"), n(2).alias("lat"))


@register(f"SELECT id, status, lon FROM {POINTS}")
def snk03_write_geojsonseq(spark, sf_dir):
    path = scratch(spark, "seq")
    sinks.write_geojsonseq(points(spark, sf_dir).withColumn("geometry", sinks.geometry_json()).select("id", "status", "geometry"), path)
    g = lambda p: F.get_json_object("value", p)
    return spark.read.text(path).select(g("$.properties.id").cast("bigint").alias("id"), g("$.properties.status").alias("status"), g("$.geometry.coordinates[0]").cast("double").alias("lon"))


@register(f"SELECT id, lat FROM {POINTS}")
def snk04_write_geojson(spark, sf_dir):
    path = scratch(spark, "collections")
    sinks.write_geojson(points(spark, sf_dir).withColumn("geometry", sinks.geometry_json()).select("id", "geometry"), path, shards=4)
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    return docs.select(F.get_json_object("f", "$.properties.id").cast("bigint").alias("id"), F.get_json_object("f", "$.geometry.coordinates[1]").cast("double").alias("lat"))


@register(f"SELECT status AS part, min(lon) AS minx, max(lat) AS maxy, 'Point' AS types FROM {POINTS} GROUP BY status")
def snk05_write_meta(spark, sf_dir):
    p = points(spark, sf_dir)
    path = scratch(spark, "meta")
    sinks.write_meta(readers.schema_table(p), p, profiles.partition_extents(p, "status").withColumnRenamed("status", "part"), path)
    text = spark.read.text(path).withColumn("types", F.array_join(F.from_json(F.get_json_object("value", "$.geometry_types"), "array<string>"), ","))
    return readers.extents_rows(text, keep=("types",)).select("part", "minx", "maxy", "types")


@register(f"SELECT 'repo-' || dataset AS repo, count(*) AS fields, CAST(sum(distinct_values) AS BIGINT) AS distinct_values FROM ({PROFILE}) GROUP BY 1")
def snk06_write_profiles(spark, sf_dir):
    path = scratch(spark, "profiles")
    rows = _profiled(spark, sf_dir).withColumn("repo", F.concat(F.lit("repo-"), "dataset")).withColumn("tag", F.lit("v1"))
    sinks.write_profiles(rows, path)
    return spark.read.json(path).groupBy("repo").agg(F.count("column").alias("fields"), F.sum("distinct_values").alias("distinct_values"))


@register(f"SELECT id, status FROM {POINTS} WHERE {IN_TRIANGLE}")
def st01_stream_filter(spark, sf_dir):
    landed, out, check = (scratch(spark, x) for x in ("landed", "filtered", "progress"))
    _point_lines(spark, sf_dir).select("value").write.text(landed)
    query = stream.stream_filter(spark, landed, out, TRIANGLE, {"id": "int", "status": "str"}, check)
    query.awaitTermination()
    return spark.read.parquet(out).select("id", "status")


@register("SELECT CAST(count(*) FILTER (WHERE event_id % 13 = 0) AS BIGINT) AS unparsed, count(*) AS n FROM events")
def st02_stream_counters(spark, sf_dir):
    landed, out, check = (scratch(spark, x) for x in ("landed", "filtered", "progress"))
    _event_lines(spark, sf_dir).select("line").write.text(landed)
    counters = stream.Counters()
    query = stream.stream_filter(spark, landed, out, TRIANGLE, {"whole": "int"}, check, counters=counters)
    query.awaitTermination()
    seen = counters.of(query)
    spark.streams.removeListener(counters)
    return spark.createDataFrame([(seen["unparsed"], seen["count"])], "unparsed bigint, n bigint")


@register("SELECT 'd' || CAST(p_partkey AS VARCHAR) AS dataset, CAST(1 AS BIGINT) AS times FROM part")
def st03_process_new(spark, sf_dir):
    landing, done, check = (scratch(spark, x) for x in ("landing", "done", "progress"))
    p = table(spark, sf_dir, "part")
    write = lambda df: df.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("dataset")).write.mode("append").json(landing)
    keep = lambda df: df.select("dataset")
    first, rest = p.where("p_size % 3 < 2"), p.where("p_size % 3 > 0")
    write(first.unionAll(first))  # each lands twice in a batch
    stream.process_new(spark, landing, done, keep, check, "dataset string").awaitTermination()
    write(rest)  # some land again
    stream.process_new(spark, landing, done, keep, check, "dataset string").awaitTermination()
    return stream.processed(spark, done).groupBy("dataset").agg(F.count(F.lit(1)).alias("times"))


def _item_tables(spark, sf_dir):
    """Items written as item tables, a folder for each collection with files in the order of the items, with the columns that such tables have, and read back."""
    path = scratch(spark, "items")
    box = F.struct(F.col("w").alias("xmin"), F.col("s").alias("ymin"), F.col("e").alias("xmax"), F.col("n").alias("ymax"))
    none = lambda kind: F.lit(None).cast(kind)
    thumbnail = F.create_map(F.lit("data"), F.struct(F.concat(F.lit("https://h/"), F.col("item_pos").cast("string"), F.lit(".tif")).alias("href")))
    odd = F.col("item_pos") % 2 == 1
    raw = items(spark, sf_dir).repartitionByRange("collection", "item_pos").sortWithinPartitions("collection", "item_pos").select(
        F.when(~F.col("id").startswith("item-"), F.col("id")).alias("id"), F.when(odd, thumbnail).alias("assets"), box.alias("bbox"), none("binary").alias("geometry"),
        none("array<string>").alias("links"), F.when(odd, F.array(F.lit("https://x/projection"))).otherwise(F.array().cast("array<string>")).alias("stac_extensions"),
        F.when(F.col("version") != "1.0.0", F.col("version")).alias("stac_version"), F.lit("Feature").alias("type"), F.timestamp_seconds(F.col("item_pos")).alias("datetime"),
        F.when(odd, F.lit(4326)).cast("bigint").alias("proj:epsg"), F.when(odd, F.array(F.lit(256), F.lit(512))).cast("array<bigint>").alias("proj:shape"),
        F.when(odd, F.array(F.lit(0.5), F.lit(0.25))).alias("proj:transform"), "collection",
    )
    raw.write.partitionBy("collection").parquet(path)
    each = [readers.read_stac_items(spark, f"{path}/collection={c}", c) for c in ("c0", "c1")]
    return each[0].unionByName(each[1])


_NUMBERED = f"(SELECT *, CASE WHEN id LIKE 'item-%' THEN concat('item-', CAST(row_number() OVER (PARTITION BY collection ORDER BY item_pos) - 1 AS VARCHAR)) ELSE id END AS name FROM {ITEMS})"


@register(f"SELECT collection, name AS id, version AS stac_version, w AS west FROM {_NUMBERED}")
def src08_read_stac_items(spark, sf_dir):
    return _item_tables(spark, sf_dir).select("collection", "id", "stac_version", F.get("bbox", 0).alias("west"))


@register(f"""SELECT collection, name AS id, '/stac/collections/' || collection || '/items/' || name AS self, w AS west, 5 AS corners, strftime(make_timestamp(item_pos * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS datetime,
 CASE WHEN item_pos % 2 = 1 THEN 4326 END AS epsg, CASE WHEN item_pos % 2 = 1 THEN 512 END AS rows, CASE WHEN item_pos % 2 = 1 THEN 0.25::DOUBLE END AS step,
 CASE WHEN item_pos % 2 = 1 THEN 'https://h/' || CAST(item_pos AS VARCHAR) || '.tif' END AS href, CASE WHEN item_pos % 2 = 1 THEN '["https://x/projection"]' END AS extensions, CASE WHEN item_pos % 2 = 0 THEN '{{}}' END AS no_assets FROM {_NUMBERED}""")
def f25_stac_documents(spark, sf_dir):
    from ..operators import stac

    d = stac.stac_documents(_item_tables(spark, sf_dir))
    get = lambda p: F.get_json_object("document", p)
    return d.select(
        "collection", "id", get("$.links[0].href").alias("self"), get("$.bbox[0]").cast("double").alias("west"), F.json_array_length(get("$.geometry.coordinates[0]")).alias("corners"),
        get("$.properties.datetime").alias("datetime"), get("$.properties['proj:epsg']").cast("int").alias("epsg"), get("$.properties['proj:shape'][1]").cast("int").alias("rows"),
        get("$.properties['proj:transform'][1]").cast("double").alias("step"), get("$.assets.data.href").alias("href"), get("$.stac_extensions").alias("extensions"),
        F.when(get("$.assets.data").isNull(), get("$.assets")).alias("no_assets"),
    )


def _collections(spark, sf_dir):
    """The collections of the item tables, and one without items."""
    known = items(spark, sf_dir).groupBy(F.col("collection").alias("id")).agg(F.min("collection_pos").alias("pos"))
    return known.union(known.agg(F.lit("none"), F.lit(2))).withColumn("title", F.concat(F.lit("Orders "), "id"))


@register(f"""SELECT collection AS id, 'Orders ' || collection AS title, min(w) AS west, max(n) AS north, '/stac/collections/' || collection || '/items' AS items FROM {ITEMS} GROUP BY collection
UNION ALL SELECT 'none', 'Orders none', -180.0, 90.0, '/stac/collections/none/items'""")
def f25_collection_documents(spark, sf_dir):
    from ..operators import stac

    d = stac.collection_documents(_collections(spark, sf_dir), _item_tables(spark, sf_dir))
    get = lambda p: F.get_json_object("document", p)
    return d.select("id", get("$.title").alias("title"), get("$.extent.spatial.bbox[0][0]").cast("double").alias("west"), get("$.extent.spatial.bbox[0][3]").cast("double").alias("north"), get("$.links[2].href").alias("items"))


@register(f"SELECT '/stac/collections/' || collection AS href, min(collection_pos) + 5 AS place FROM {ITEMS} GROUP BY collection UNION ALL SELECT '/stac/collections/none', 7")
def f25_catalog_document(spark, sf_dir):
    from ..operators import stac

    d = stac.catalog_document(_collections(spark, sf_dir))
    links = d.select(F.posexplode(F.from_json(F.get_json_object("document", "$.links"), "array<struct<rel: string, href: string>>")).alias("place", "link"))
    return links.where("link.rel = 'child'").select("link.href", "place")


@register("SELECT p_partkey AS polygon_id, p_name AS name FROM part")
def snk04_polygons_geojson(spark, sf_dir):
    path = scratch(spark, "polygons")
    p = parcels(spark, sf_dir).withColumn("geometry", sinks.geometry_json()).select("polygon_id", "name", "geometry")
    sinks.write_geojson(p, path, shards=4)
    return readers.read_filter_layer(spark, path).select(F.col("properties")["polygon_id"].cast("bigint").alias("polygon_id"), F.col("properties")["name"].alias("name"))


@register(f"SELECT CAST(count(*) AS BIGINT) AS n FROM {POINTS}")
def snk01_write_leaves(spark, sf_dir):
    path = scratch(spark, "leaves")
    partitioning.write_partitioned(partitioning.kd_partition(points(spark, sf_dir), 8), path)
    return readers.read_features(spark, path).agg(F.count(F.lit(1)).alias("n"))


#: Names of properties over two files, a small one and a large one, in the order in which they are first seen.
_SEEN = """(SELECT key, row_number() OVER (ORDER BY file, line, place) AS position FROM (SELECT key, min(file) AS file, min_by(line, (file, line, place)) AS line, min_by(place, (file, line, place)) AS place FROM (
    SELECT n_name AS key, 0 AS file, n_nationkey AS line, 0 AS place FROM nation
    UNION ALL SELECT lower(n_name), 1, c_custkey, 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT concat('geom_', c_mktsegment), 1, c_custkey, 1 FROM customer
    UNION ALL SELECT concat('my_geom', n_regionkey), 0, n_nationkey, 1 FROM nation) GROUP BY key))"""


def _two_files(spark, sf_dir):
    """Nations in one file, customers with the same names in lower case in a larger one."""
    nation = table(spark, sf_dir, "nation")
    path = scratch(spark, "ordered")
    named = lambda key, other: F.to_json(F.struct(F.create_map(key, F.lit("1"), other, F.lit("x")).alias("properties")))
    small = nation.orderBy("n_nationkey").coalesce(1).select(named("n_name", F.concat(F.lit("my_geom"), "n_regionkey")))
    small.write.text(f"{path}/a")
    large = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).coalesce(1).sortWithinPartitions("c_custkey")
    large.select(named(F.lower("n_name"), F.concat(F.lit("geom_"), "c_mktsegment"))).write.text(f"{path}/b")
    return readers.read_geojsonl(spark, [f"{path}/b", f"{path}/a"], order="at")


@register(f"SELECT key, CAST(position AS INT) AS position, CASE WHEN key IN (SELECT lower(n_name) FROM nation) THEN concat(key, '_2') ELSE key END AS new_key FROM {_SEEN}")
def a03_order_over_files(spark, sf_dir):
    """Which of two names that differ in case keeps its own: the one seen first, whatever the files' sizes."""
    from ..operators import schema

    lines = _two_files(spark, sf_dir)
    keys = [r["key"] for r in schema.infer_properties(lines, order="at").orderBy("first").collect()]  # one row a name
    renames = schema.case_renames(keys)
    return spark.createDataFrame([(k, i + 1, renames.get(k, k)) for i, k in enumerate(keys)], "key string, position int, new_key string")


@register(f"SELECT key, concat('geom_renamed_', CAST(row_number() OVER (ORDER BY position) AS VARCHAR)) AS new_key FROM {_SEEN} WHERE key LIKE '%geom%'")
def f12_order_over_files(spark, sf_dir):
    from ..operators import filters

    return filters.geometry_name_renames(_two_files(spark, sf_dir), order="at")
