"""Feature filters, cleaning and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import shifted_point, significant_digits


def parse_bounds(bounds) -> tuple[float, float, float, float]:
    """West, south, east, north from text or numbers; raises where they aren't a box within the world."""
    values = bounds.split(",") if isinstance(bounds, str) else list(bounds)
    if len(values) != 4:
        raise ValueError("bounds need four numbers: min_lon,min_lat,max_lon,max_lat")
    w, s, e, n = map(float, values)
    if not (-180 <= w <= 180 and -180 <= e <= 180 and -90 <= s <= 90 and -90 <= n <= 90 and w < e and s < n):
        raise ValueError(f"not a box within the world: {bounds}")
    return w, s, e, n


def bbox_overlaps(bounds, box: str = "bbox") -> Column:
    """Closed overlap of a box column with bounds; reaches the Parquet scan."""
    w, s, e, n = parse_bounds(bounds)
    b = F.col(box)
    return (b["xmin"] <= e) & (b["xmax"] >= w) & (b["ymin"] <= n) & (b["ymax"] >= s)


def bbox_column_filter(df: DataFrame, bounds) -> DataFrame:
    """Rows whose box column overlaps the bounds."""
    return df.where(bbox_overlaps(bounds))


def box_polygon(bounds) -> list:
    w, s, e, n = parse_bounds(bounds)
    return [[(w, s), (e, s), (e, n), (w, n), (w, s)]]


def bbox_filter(df: DataFrame, bounds) -> DataFrame:
    """Rows whose geometry meets the bounds: the box first, the geometry where it isn't a point."""
    exact = G.intersects(F.col("coords"), F.col("geom_type"), G.polygon_edges(box_polygon(bounds)))
    return df.where(bbox_overlaps(bounds)).where(F.when(F.col("geom_type") == "Point", True).otherwise(exact))


def shape_filter(df: DataFrame, rings: list) -> DataFrame:
    """Rows whose geometry meets a polygon; the envelope is tested first and reaches the scan."""
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    b = F.col("bbox")
    near = (b["xmin"] <= max(xs)) & (b["xmax"] >= min(xs)) & (b["ymin"] <= max(ys)) & (b["ymax"] >= min(ys))
    exact = G.intersects(F.col("coords"), F.col("geom_type"), G.polygon_edges(rings))
    return df.where(near).where(F.when(near, exact).otherwise(False))


def _exactly_one(layer: DataFrame, what: str) -> DataFrame:
    n = layer.limit(2).count()
    if n != 1:
        raise ValueError(f"{what}: {'no polygon' if n == 0 else 'more than one polygon'} matches")
    return layer


def pick_by_index(layer: DataFrame, k: int) -> DataFrame:
    """The layer's polygon number ``k``; raises where there is none."""
    return _exactly_one(layer.where(F.col("pos") == k), f"index {k}")


def pick_by_kv(layer: DataFrame, pairs: list[str]) -> DataFrame:
    """The one polygon whose properties, as text, have all the ``key=value`` pairs."""
    found = layer
    for pair in pairs:
        key, mark, value = pair.partition("=")
        if not mark:
            raise ValueError(f"not key=value: {pair}")
        # a missing key reads as the text None
        found = found.where(F.coalesce(F.col("properties")[key], F.lit("None")) == value)
    return _exactly_one(found, " ".join(pairs))


def drop_empty_geometry(df: DataFrame, line: str = "line") -> DataFrame:
    """Feature lines whose geometry has coordinates, and a first element that isn't empty."""
    coordinates = F.get_json_object(line, "$.geometry.coordinates")
    first = F.get_json_object(line, "$.geometry.coordinates[0]")
    return df.where(coordinates.isNotNull() & (F.regexp_replace(coordinates, r"\s", "") != "[]") & first.isNotNull() & (F.regexp_replace(first, r"\s", "") != "[]"))


#: Default region: west, south, east, north.
REGION = (67.0, 5.0, 98.0, 38.0)


def _within(x: Column, y: Column, region) -> Column:
    w, s, e, n = region
    return (x >= w) & (x <= e) & (y >= s) & (y <= n)


def all_in_region(coords: Column, region=REGION) -> Column:
    """Whether every position is within the region; a position without two numbers is not, a geometry without positions is."""
    return F.coalesce(F.forall(G.vertices(coords), lambda p: F.coalesce(_within(F.get(p, 0), F.get(p, 1), region), F.lit(False))), F.lit(True))


def repair_pair(lon: Column, lat: Column, region=REGION) -> Column:
    """``struct(lon, lat, rule)``: the first repair that brings a position into the region; rule null where none does."""
    w, s, e, n = region

    def fixed(x: Column, y: Column, rule: str) -> Column:
        return F.struct(x.alias("lon"), y.alias("lat"), F.lit(rule).alias("rule"))

    digits = F.struct(significant_digits(lon).alias("lon"), significant_digits(lat).alias("lat"))

    def shifts(d: Column) -> Column:
        parts = {"dx": (lon, d["lon"], w, e), "dy": (lat, d["lat"], s, n), "sx": (lat, d["lat"], w, e), "sy": (lon, d["lon"], s, n)}
        return F.struct(*[shifted_point(*p).alias(k) for k, p in parts.items()])

    broken = F.struct(lon.alias("lon"), lat.alias("lat"), F.lit(None).cast("string").alias("rule"))

    def shifted(c: Column) -> Column:
        plain = F.when(c["dx"].isNotNull() & c["dy"].isNotNull(), fixed(c["dx"], c["dy"], "decimal"))
        return plain.when(c["sx"].isNotNull() & c["sy"].isNotNull(), fixed(c["sx"], c["sy"], "swapped+decimal")).otherwise(broken)

    return (
        F.when(_within(lon, lat, region), fixed(lon, lat, "kept"))
        .when(lon == lat, broken)
        .when(_within(lat, lon, region), fixed(lat, lon, "swapped"))
        .otherwise(F.get(F.transform(F.transform(F.array(digits), shifts), shifted), 0))
    )


def repair_coords(df: DataFrame, region=REGION, coords: str = "coords") -> DataFrame:
    """Repair every position; features without positions or with one beyond repair are dropped, ``rules`` lists the repairs made."""

    def position(p: Column) -> Column:
        return F.struct(repair_pair(F.get(p, 0), F.get(p, 1), region).alias("fix"), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))).alias("rest"))

    def nested(c: Column, f, depth: int = 2) -> Column:
        return F.transform(c, f) if depth == 0 else F.transform(c, lambda x: nested(x, f, depth - 1))

    def repaired(c: Column) -> Column:
        flat = F.flatten(F.flatten(c))
        rules = F.array_sort(F.array_distinct(F.filter(F.transform(flat, lambda p: p["fix"]["rule"]), lambda r: r != "kept")))
        back = nested(c, lambda p: F.concat(F.array(p["fix"]["lon"], p["fix"]["lat"]), p["rest"]))
        return F.when(F.forall(flat, lambda p: p["fix"]["rule"].isNotNull()), F.struct(back.alias("coords"), rules.alias("rules")))

    # most features need no repair; what does is worked out once, in the generator, and dropped there if it can't be done
    kept = F.array(F.struct(F.col(coords).alias("coords"), F.array().cast("array<string>").alias("rules")))
    fixed = F.when(F.col(coords).isNotNull() & all_in_region(F.col(coords), region), kept).otherwise(F.array_compact(F.transform(F.array(nested(F.col(coords), position)), repaired)))
    out = df.withColumn("_fixed", F.explode(fixed))
    return out.withColumn("rules", F.col("_fixed.rules")).withColumn(coords, F.col("_fixed.coords")).drop("_fixed")


def rename_props(df: DataFrame, renames: dict[str, str], column: str | None = None) -> DataFrame:
    """Rename columns, or the keys of a map column, where they are present."""
    if column is None:
        return df.withColumnsRenamed(renames)
    names = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    return df.withColumn(column, F.transform_keys(column, lambda k, _: F.coalesce(F.element_at(names, k), k)))


SQL_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string"}


def normalize_props(df: DataFrame, schema: dict[str, str], properties: str = "properties") -> DataFrame:
    """Exactly the schema's properties as a struct of the JSON text ``properties``; missing ones null, others dropped."""
    if not schema:
        return df
    fields = ", ".join(f"`{k}`: {SQL_TYPES.get(t, 'string')}" for k, t in schema.items())
    return df.withColumn(properties, F.from_json(F.coalesce(properties, F.lit("{}")), f"struct<{fields}>"))


def _property_names(line: str) -> Column:
    """Names of a feature line's properties, in order; null for a line that isn't JSON."""
    return F.map_keys(F.from_json(line, "struct<properties: map<string, string>>", {"allowNonNumericNumbers": "false"})["properties"])


def geometry_name_renames(df: DataFrame, line: str = "line", order: str | None = None) -> DataFrame:
    """``key`` and ``new_key`` of properties whose name contains ``geom``, numbered by first appearance in the order of the lines."""
    rows = df.withColumn("_n", F.col(order) if order else F.monotonically_increasing_id())
    keys = rows.select("_n", F.posexplode(_property_names(line)).alias("_p", "key"))
    seen = keys.where(F.lower("key").contains("geom")).groupBy("key").agg(F.min(F.struct("_n", "_p")).alias("first"))
    names = [r["key"] for r in seen.orderBy("first").collect()]  # one row a column name
    new = [(k, f"geom_renamed_{i + 1}") for i, k in enumerate(names)]
    return df.sparkSession.createDataFrame(new, "key string, new_key string")


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    escaped = F.get(F.transform(F.array(F.to_json(F.array(text))), lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), 0)
    return F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _members(json: Column) -> Column:
    """``struct(key, value)`` of a JSON object's members, in order, the values as JSON text; null for other text."""
    found = F.struct(F.from_json(json, "map<string, string>").alias("texts"), F.from_json(json, "map<string, variant>").alias("kinds"))

    def text(e: Column, kinds: Column) -> Column:
        is_text = F.schema_of_variant(F.element_at(kinds, e["key"])) == "STRING"
        return F.struct(e["key"].alias("key"), F.when(e["value"].isNull(), "null").when(is_text, _quoted(e["value"])).otherwise(e["value"]).alias("value"))

    # the object is parsed once, not once a member
    return F.get(F.transform(F.array(found), lambda f: F.transform(F.map_entries(f["texts"]), lambda e: text(e, f["kinds"]))), 0)


def _object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def rename_geom_props(df: DataFrame, line: str = "line", order: str | None = None) -> DataFrame:
    """Feature lines with such properties renamed; nothing but the names of properties changes, lines that aren't JSON stay."""
    renames = {r["key"]: r["new_key"] for r in geometry_name_renames(df, line, order).collect()}  # one row a property name
    if not renames:
        return df
    names = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])

    def renamed(properties: Column) -> Column:
        return F.transform(_members(properties), lambda e: F.struct(F.coalesce(F.element_at(names, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))

    members = F.transform(
        _members(F.col(line)), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "properties", F.coalesce(_object(renamed(e["value"])), e["value"])).otherwise(e["value"]).alias("value"))
    )
    touched = F.exists(_property_names(line), lambda k: F.element_at(names, k).isNotNull())
    return df.withColumn(line, F.when(touched, _object(members)).otherwise(F.col(line)))


def geometry_class(df: DataFrame, cls: str, kind: str = "geom_type") -> DataFrame:
    """Features of a class: polygon, line or point."""
    members = {"polygon": ("Polygon", "MultiPolygon"), "line": ("LineString", "MultiLineString"), "point": ("Point", "MultiPoint")}
    return df.where(F.col(kind).isin(*members[cls]))


def height(props: Column) -> Column:
    """Height of a feature that states one under any of its names, 3 where the stated one is no number; null where none is there."""
    any_ = F.array_contains(F.map_keys(props), "Height") | F.array_contains(F.map_keys(props), "HEIGHT") | F.array_contains(F.map_keys(props), "height")
    return F.when(any_, F.coalesce(*[F.element_at(props, k).try_cast("double") for k in ("Height", "HEIGHT", "height")], F.lit(3.0)))


#: Names that label a feature, best first; fixed values.
LABEL_NAMES = ("HAB_NAME", "NAME", "name", "id", "ID")


def feature_label(props: Column) -> Column:
    """A feature's label: the first of its naming properties, else its first text that isn't empty."""
    return F.coalesce(*[F.element_at(props, k) for k in LABEL_NAMES], F.get(F.filter(F.map_values(props), lambda v: v.isNotNull() & (v != "")), 0), F.lit("(no name)"))


def with_counters(df: DataFrame, name: str, **conditions: Column):
    """``df`` observed: rows and, for each condition, the rows that meet it, without a second pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("count"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen
