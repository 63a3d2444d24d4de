"""Queries: filters, cleaning, inference, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import filters, profiles, schema
from ..sources import readers
from .inputs import DIRTY, IN_TRIANGLE, POINTS, POLYGONS, TRIANGLE, dirty, parcels, points, polygons, table
from .registry import Registry

REGISTRY = register = Registry()

BOX = "72,10,85,25"
IN_BOX = "lon >= 72 AND lon <= 85 AND lat >= 10 AND lat <= 25"


@register(f"SELECT status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, round(min(price), 2) AS low, round(max(price), 2) AS high FROM {POINTS} WHERE {IN_BOX} AND {IN_TRIANGLE} GROUP BY status")
def flagship_extract(spark, sf_dir):
    found = filters.shape_filter(filters.bbox_filter(points(spark, sf_dir), BOX), TRIANGLE)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.round(F.min("price"), 2).alias("low"), F.round(F.max("price"), 2).alias("high"))


@register(f"SELECT id, lon, lat FROM {POINTS} WHERE {IN_BOX}")
def f01_bbox_filter(spark, sf_dir):
    return filters.bbox_filter(points(spark, sf_dir), BOX).select("id", "lon", "lat")


@register(f"SELECT id, lon, lat FROM {POINTS} WHERE {IN_TRIANGLE}")
def f02_shape_filter(spark, sf_dir):
    return filters.shape_filter(points(spark, sf_dir), TRIANGLE).select("id", "lon", "lat")


@register(f"SELECT id FROM {POINTS} WHERE {IN_BOX}")
def f03_bbox_column(spark, sf_dir):
    return filters.bbox_column_filter(points(spark, sf_dir), BOX).select("id")


def _layer(spark, sf_dir):
    """Parts as a filter layer."""
    rows = parcels(spark, sf_dir)
    props = F.create_map(F.lit("filter_id"), F.col("name"), F.lit("value"), (F.col("polygon_id") * 100).cast("string"))
    return rows.select(F.col("polygon_id").alias("pos"), props.alias("properties"), "name", "x0", "y0")


@register("SELECT p_name AS name, p_partkey AS pos FROM part WHERE p_partkey = 7")
def f04_pick_by_index(spark, sf_dir):
    return filters.pick_by_index(_layer(spark, sf_dir), 7).select("name", "pos")


@register("SELECT p_name AS name, p_partkey AS pos FROM part WHERE p_partkey * 100 = 900")
def f05_pick_by_kv(spark, sf_dir):
    return filters.pick_by_kv(_layer(spark, sf_dir), ["value=900"]).select("name", "pos")


def _lines(spark, sf_dir):
    """Dirty points as feature lines, some without geometry and some of other shapes."""
    d = dirty(spark, sf_dir)
    xy = F.concat(F.lit("["), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    geometry = (
        F.when(F.col("id") % 11 == 0, F.lit("null"))
        .when(F.col("id") % 11 == 1, F.lit('{"type":"Polygon","coordinates":[]}'))
        .when(F.col("id") % 11 == 2, F.lit('{"type":"Polygon","coordinates":[[]]}'))
        .when(F.col("id") % 11 == 3, F.lit('{"type":"GeometryCollection","geometries":[]}'))
        .when(F.col("id") % 11 == 4, F.concat(F.lit('{"type":"LineString","coordinates":['), xy, F.lit(",[70,10]]}")))
        .otherwise(F.concat(F.lit('{"type":"Point","coordinates":'), xy, F.lit("}")))
    )
    props = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"geom_area":'), F.col("line_number").cast("string"), F.lit(',"myGeom":"x"}'))
    return d.withColumn("line", F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}")))


@register(f"SELECT id, line_number FROM {DIRTY} WHERE id % 11 > 3")
def f06_drop_empty_geometry(spark, sf_dir):
    return filters.drop_empty_geometry(_lines(spark, sf_dir)).select("id", "line_number")


@register(f"SELECT id, line_number, lon >= 67 AND lon <= 98 AND lat >= 5 AND lat <= 38 AS inside FROM {DIRTY}")
def f07_all_in_region(spark, sf_dir):
    return dirty(spark, sf_dir).select("id", "line_number", filters.all_in_region(F.col("coords")).alias("inside"))


_IN = "{0} >= 67 AND {0} <= 98 AND {1} >= 5 AND {1} <= 38"


def _shifted(v: str, lo: int, hi: int) -> str:
    """DuckDB: the first place of the decimal point, after one to four digits, that brings a value within bounds."""
    d = f"ltrim(replace(rtrim(printf('%.10f', {v}), '0'), '.', ''), '0')"
    tries = f"list_transform(list_filter([1, 2, 3, 4], lambda k: k < length({d})), lambda k: CAST(left({d}, k) || '.' || substr({d}, k + 1) AS DOUBLE))"
    return f"CASE WHEN {v} BETWEEN {lo} AND {hi} THEN {v} ELSE list_filter({tries}, lambda c: c BETWEEN {lo} AND {hi})[1] END"


_REPAIRED = f"""
SELECT id, line_number, CASE rule WHEN 'swapped' THEN lat WHEN 'decimal' THEN dx WHEN 'swapped+decimal' THEN sx ELSE lon END AS lon,
  CASE rule WHEN 'swapped' THEN lon WHEN 'decimal' THEN dy WHEN 'swapped+decimal' THEN sy ELSE lat END AS lat, rule AS rules
FROM (SELECT *, CASE WHEN {_IN.format('lon', 'lat')} THEN '' WHEN lon = lat THEN NULL WHEN {_IN.format('lat', 'lon')} THEN 'swapped' WHEN dx IS NOT NULL AND dy IS NOT NULL THEN 'decimal' WHEN sx IS NOT NULL AND sy IS NOT NULL THEN 'swapped+decimal' END AS rule
  FROM (SELECT *, {_shifted('lon', 67, 98)} AS dx, {_shifted('lat', 5, 38)} AS dy, {_shifted('lat', 67, 98)} AS sx, {_shifted('lon', 5, 38)} AS sy FROM {DIRTY})) WHERE rule IS NOT NULL"""


@register(_REPAIRED)
def f08_coord_repair(spark, sf_dir):
    fixed = filters.repair_coords(dirty(spark, sf_dir))
    p = F.get(F.get(F.get(F.get("coords", 0), 0), 0), 0), F.get(F.get(F.get(F.get("coords", 0), 0), 0), 1)
    return fixed.select("id", "line_number", p[0].alias("lon"), p[1].alias("lat"), F.array_join("rules", ",").alias("rules"))


@register(f"SELECT id, line_number, {_shifted('lon', 67, 98)} AS fixed FROM {DIRTY}")
def f09_fix_decimal(spark, sf_dir):
    from ..functions.scalars import fix_decimal

    return dirty(spark, sf_dir).select("id", "line_number", fix_decimal(F.col("lon"), 67.0, 98.0).alias("fixed"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS kind_k FROM events")
def f10_rename_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("properties", F.from_json("props", "map<string, string>"))
    renamed = filters.rename_props(rows, {"k": "kind_k", "absent": "other"}, "properties")
    return renamed.select("event_id", F.element_at("properties", F.lit("kind_k")).alias("kind_k"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def f11_normalize_props(spark, sf_dir):
    rows = filters.normalize_props(table(spark, sf_dir, "events").withColumnRenamed("props", "properties"), {"k": "int", "absent": "str"})
    return rows.select("event_id", "properties.*")


@register(f"""SELECT id, line_number, CAST(id AS VARCHAR) AS kept, CAST(line_number AS VARCHAR) AS first_geom, 'x "geometry": y' AS second_geom, 'inner' AS third_geom,
 CASE WHEN id % 11 = 0 THEN NULL WHEN id % 11 <= 2 THEN 'Polygon' WHEN id % 11 = 3 THEN 'GeometryCollection' WHEN id % 11 = 4 THEN 'LineString' ELSE 'Point' END AS own_geometry FROM {DIRTY}""")
def f12_rename_geom_props(spark, sf_dir):
    more = r'"myGeom":"x \"geometry\": y","geometry":{"geom":"inner"}'
    lines = _lines(spark, sf_dir).withColumn("line", F.replace("line", F.lit('"myGeom":"x"'), F.lit(more)))
    rows = filters.rename_geom_props(lines)
    g = lambda k: F.get_json_object("line", f"$.properties.{k}")
    names = {"id": "kept", "geom_renamed_1": "first_geom", "geom_renamed_2": "second_geom", "geom_renamed_3.geom": "third_geom"}
    return rows.select("id", "line_number", *[g(k).alias(n) for k, n in names.items()], F.get_json_object("line", "$.geometry.type").alias("own_geometry"))


@register("SELECT p_partkey AS part, p_name AS name, CASE WHEN p_partkey % 2 = 1 THEN 4 ELSE 5 END AS corners, 'POLYGON' AS kind FROM part")
def f13_with_wkt(spark, sf_dir):
    from ..sources.sinks import with_wkt

    rows = with_wkt(parcels(spark, sf_dir))
    return rows.select(F.col("polygon_id").alias("part"), "name", F.size(F.split("wkt", ", ")).alias("corners"), F.substring_index("wkt", " ", 1).alias("kind"))


@register("SELECT CASE WHEN p_partkey % 2 = 1 THEN 'triangle' ELSE 'square' END AS shape, count(*) AS n FROM part GROUP BY 1")
def f22_geometry_class(spark, sf_dir):
    rows = filters.geometry_class(parcels(spark, sf_dir), "polygon")
    return rows.groupBy(F.when(F.col("triangle"), "triangle").otherwise("square").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN 3.0::DOUBLE END AS height FROM part")
def f22_height(spark, sf_dir):
    props = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("HEIGHT"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("height"), F.lit("tall"))).otherwise(F.create_map(F.lit("x"), F.lit("1")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), filters.height(props).alias("height"))


@register("SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN p_brand ELSE '(no name)' END AS label FROM part")
def f23_feature_label(spark, sf_dir):
    k = F.col("p_partkey") % 4
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    props = F.when(k == 0, m("id", F.lit("7"), "name", F.col("p_name"))).when(k == 1, m("x", F.lit("y"), "ID", F.col("p_partkey").cast("string"))).when(k == 2, m("a", F.lit(""), "b", F.col("p_brand"))).otherwise(m("a", F.lit("")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), filters.feature_label(props).alias("label"))


def _event_lines(spark, sf_dir):
    """Events as feature lines with properties of mixed types; every 13th isn't JSON."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    mixed = F.when(F.col("event_id") % 2 == 0, k).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    number = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    maybe = F.when(F.col("event_id") % 5 == 0, F.lit("null")).otherwise(F.lit("true"))
    kind = F.when(F.col("event_id") % 4 == 0, "MultiPoint").otherwise("Point")
    line = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":[77.5,12.5]},"properties":{"type":"'), F.col("event_type"),
        F.lit('","whole":'), F.col("event_id").cast("string"), F.lit(',"number":'), number, F.lit(',"mixed":'), mixed, F.lit(',"maybe":'), maybe, F.lit(',"nothing":null}}'),
    )
    return e.select("event_id", F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(line).alias("line"))


@register("SELECT event_id % 13 = 0 AS is_bad, count(*) AS n FROM events GROUP BY 1")
def src01_geojsonl_scan(spark, sf_dir):
    return readers.parse_lines(_event_lines(spark, sf_dir)).groupBy("is_bad").agg(F.count(F.lit(1)).alias("n"))


_INFERRED = """WITH e AS (SELECT * FROM events WHERE event_id % 13 <> 0)
SELECT 'type' AS key, 'str' AS type FROM e HAVING count(*) > 0 UNION ALL SELECT 'whole', 'int' FROM e HAVING count(*) > 0 UNION ALL SELECT 'nothing', 'str' FROM e HAVING count(*) > 0
UNION ALL SELECT 'number', CASE WHEN bool_or(event_id % 3 <> 0) THEN 'float' ELSE 'int' END FROM e
UNION ALL SELECT 'mixed', CASE WHEN bool_or(event_id % 2 <> 0) THEN 'str' ELSE 'int' END FROM e
UNION ALL SELECT 'maybe', CASE WHEN bool_or(event_id % 5 <> 0) THEN 'bool' ELSE 'str' END FROM e"""


@register(_INFERRED)
def a01_infer_properties(spark, sf_dir):
    return schema.infer_properties(_event_lines(spark, sf_dir), order="event_id").select("key", "type")


@register("SELECT string_agg(DISTINCT CASE WHEN event_id % 4 = 0 THEN 'MultiPoint' ELSE 'Point' END, ',' ORDER BY CASE WHEN event_id % 4 = 0 THEN 'MultiPoint' ELSE 'Point' END) AS geometry_types FROM events WHERE event_id % 13 <> 0")
def a02_geometry_types(spark, sf_dir):
    lines = readers.parse_lines(_event_lines(spark, sf_dir)).where("not is_bad")
    return schema.geometry_types(lines).select(F.array_join("geometry_types", ",").alias("geometry_types"))


@register("SELECT CAST(e.event_id AS BIGINT) AS event_id, 'Rd_name' AS old_name, 'Rd_name_2' AS new_name, CASE WHEN e.event_id % 2 = 1 THEN event_type END AS value FROM events e")
def a03_case_renames(spark, sf_dir):
    key = F.when(F.col("event_id") % 2 == 0, "Rd_Name").otherwise("Rd_name")
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(key, F.col("event_type")).alias("properties"))
    keys = rows.select(F.explode(F.map_keys("properties")).alias("key"), "event_id").groupBy("key").agg(F.min("event_id").alias("first")).orderBy("first")
    renames = schema.case_renames([r["key"] for r in keys.collect()])
    old, new = next(iter(renames.items()))
    renamed = filters.rename_props(rows, renames, "properties")
    return renamed.select("event_id", F.lit(old).alias("old_name"), F.lit(new).alias("new_name"), F.element_at("properties", F.lit(new)).alias("value"))


@register(f"SELECT count(*) AS original, CAST(count(*) FILTER (WHERE kind IN (0, 6, 7)) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE kind IN (1, 2, 3)) AS BIGINT) AS fixed, CAST(count(*) FILTER (WHERE kind IN (4, 5)) AS BIGINT) AS dropped FROM {DIRTY}")
def a10_cleaning_counters(spark, sf_dir):
    rule = filters.repair_pair(F.col("lon"), F.col("lat"))["rule"]
    seen, counters = filters.with_counters(dirty(spark, sf_dir), "cleaning", kept=rule == "kept", fixed=rule.isNotNull() & (rule != "kept"), dropped=rule.isNull())
    seen.agg(F.count(F.lit(1))).collect()  # the pass that is observed
    c = counters.get
    return spark.createDataFrame([(c["count"], c["kept"], c["fixed"], c["dropped"])], "original bigint, kept bigint, fixed bigint, dropped bigint")


def _profiled(spark, sf_dir):
    names = ("customer", "orders", "part", "events")
    out = [profiles.profile_columns(table(spark, sf_dir, n), n) for n in names]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_TABLES = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}
PROFILE = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, CAST({i} AS INT) AS ordinal, '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, count(*) AS total, count(DISTINCT {c}) = count(*) AS is_unique FROM {t}"
    for t, cs in _TABLES.items() for i, c in enumerate(cs)
)


@register(PROFILE)
def a04_column_profile(spark, sf_dir):
    return _profiled(spark, sf_dir)


_SCORE = """CASE WHEN regexp_matches(n, 'shape|length|area|perimeter|centroid|st_area|st_length|starea|stlength') THEN NULL WHEN n = 'id' THEN 100 WHEN n IN ('uid', 'uuid') THEN 95 WHEN n LIKE '%id' THEN 80
WHEN n LIKE 'id%' THEN 75 WHEN n LIKE '%id%' THEN 60 WHEN n LIKE '%code%' THEN 50 WHEN n LIKE '%key%' THEN 45 WHEN n LIKE '%name%' THEN 20 WHEN regexp_matches(n, 'objectid|fid|inpoly|simpgn|simptol') THEN -5 ELSE 0 END"""
PICKED = f"""SELECT dataset, best, tier, picked FROM (SELECT dataset, "column" AS best, tier, CASE WHEN tier < 3 THEN "column" END AS picked,
 row_number() OVER (PARTITION BY dataset ORDER BY tier, CASE tier WHEN 1 THEN CAST(-score AS DOUBLE) ELSE -ratio END, CASE tier WHEN 1 THEN length("column") WHEN 2 THEN -score ELSE null_count END, CASE tier WHEN 3 THEN -score ELSE 0 END, ordinal) AS r
 FROM (SELECT *, distinct_values / total AS ratio, CAST(CASE WHEN is_unique THEN 1 WHEN distinct_values / total >= 0.95 THEN 2 ELSE 3 END AS INT) AS tier
 FROM (SELECT *, {_SCORE} AS score FROM (SELECT *, lower("column") AS n FROM ({PROFILE}))) WHERE score IS NOT NULL)) WHERE r = 1"""


@register(PICKED)
def w01_pick_ids(spark, sf_dir):
    return profiles.pick_ids(_profiled(spark, sf_dir)).select("dataset", "best", "tier", "picked")


@register(f"SELECT CASE WHEN dataset = 'part' THEN 'error' WHEN tier = 1 THEN 'unique' WHEN tier = 2 THEN 'candidate' ELSE 'none' END AS outcome, count(*) AS n FROM ({PICKED}) GROUP BY 1")
def a09_run_summary(spark, sf_dir):
    picks = profiles.pick_ids(_profiled(spark, sf_dir)).withColumn("error", F.when(F.col("dataset") == "part", "unreadable"))
    return profiles.run_summary(picks)


@register("SELECT CASE WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN 'skipped' WHEN p_size % 4 = 0 THEN 'error' ELSE 'processed' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def a09_process_summary(spark, sf_dir):
    from .inputs import catalog

    failed = table(spark, sf_dir, "part").where("p_size % 4 = 0").select(F.col("p_partkey").alias("pos"), F.lit("unreadable").alias("error"))
    return profiles.process_summary(catalog(spark, sf_dir).join(failed, "pos", "left"))


@register(f"SELECT \"column\", distinct_values FROM ({PROFILE}) WHERE dataset = 'orders' ORDER BY distinct_values DESC, ordinal")
def o05_order_profile(spark, sf_dir):
    return profiles.order_profile(profiles.profile_columns(table(spark, sf_dir, "orders"), "orders")).select("column", "distinct_values")


@register(f"SELECT p.polygon_id, p.name, count(*) AS n FROM {POINTS} f JOIN {POLYGONS} p ON f.lon >= p.x0 AND f.lat >= p.y0 AND f.lon <= p.x0 + 5 AND f.lat <= p.y0 + 5 AND NOT (p.triangle AND (f.lon - p.x0) + (f.lat - p.y0) > 5) GROUP BY ALL")
def j04_counts_by_polygon(spark, sf_dir):
    from ..operators.joins import spatial_join

    pairs = spatial_join(points(spark, sf_dir), polygons(spark, sf_dir))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polygon_id"), F.col("n_name").alias("name"))
    return pairs.join(names, "polygon_id").groupBy("polygon_id", "name").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey AS polygon_id, CAST(1 AS BIGINT) AS polygons, true AS same FROM part")
def wkb_round_trip(spark, sf_dir):
    rows = parcels(spark, sf_dir).withColumn("wkb", G.to_wkb("coords", "geom_type")).withColumn("back", G.from_wkb("wkb"))
    return rows.select("polygon_id", F.size("back").cast("bigint").alias("polygons"), (F.col("back") == F.col("coords")).alias("same"))
