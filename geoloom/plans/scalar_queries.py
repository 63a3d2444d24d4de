"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import notes
from .inputs import CATALOG, POINTS, SLICES, TILES, catalog, points, slices, table, tiles
from .registry import Registry

REGISTRY = register = Registry()

#: Bounds of a tile in degrees times 1e7, in DuckDB.
TILE_BOX = (
    "CAST(floor((x / pow(2, z) * 360 - 180) * 1e7 + 0.5) AS BIGINT) AS w, CAST(floor((x + 1) / pow(2, z) * 360 * 1e7 - 180 * 1e7 + 0.5) AS BIGINT) AS e, "
    "CAST(floor(degrees(atan((exp(pi() * (1 - 2 * (y + 1) / pow(2, z))) - exp(-pi() * (1 - 2 * (y + 1) / pow(2, z)))) / 2)) * 1e7 + 0.5) AS BIGINT) AS s, "
    "CAST(floor(degrees(atan((exp(pi() * (1 - 2 * y / pow(2, z))) - exp(-pi() * (1 - 2 * y / pow(2, z)))) / 2)) * 1e7 + 0.5) AS BIGINT) AS n"
)


@register(f"SELECT part, {TILE_BOX} FROM {TILES}")
def g01_tile_bbox(spark, sf_dir):
    rows = tiles(spark, sf_dir).withColumn("b", S.tile_bbox_e7(F.col("z"), F.col("x"), F.col("y")))
    return rows.select("part", "b.*")


@register(f"SELECT id, round(degrees(lon * 100000 / 6378137.0), 6) AS lon, round(degrees(2 * atan(exp(lat * 100000 / 6378137.0)) - pi() / 2), 6) AS lat FROM {POINTS}")
def g02_mercator(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("m", S.mercator_to_lonlat(F.col("lon") * 100000, F.col("lat") * 100000))
    return p.select("id", F.round("m.lon", 6).alias("lon"), F.round("m.lat", 6).alias("lat"))


@register("""SELECT part, round(minx + dx * width, 3) AS maxx, round(maxy - dx * height, 3) AS miny, round(degrees(minx / 6378137.0), 6) AS west, round(degrees(2 * atan(exp(maxy / 6378137.0)) - pi() / 2), 6) AS north, CASE WHEN maxy IS NOT NULL THEN dx END AS resolution
FROM (SELECT p_partkey AS part, CAST(1 + p_size AS DOUBLE) AS dx, CAST(8000000 + p_partkey * 100 AS DOUBLE) AS minx, CASE WHEN p_partkey % 10 <> 0 THEN CAST(2000000 + p_partkey * 50 AS DOUBLE) END AS maxy, 256 AS width, 512 AS height FROM part) WHERE maxy IS NOT NULL
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 0""")
def g03_raster_footprint(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS part", "CAST(1 + p_size AS DOUBLE) AS scale_x", "CAST(1 + p_size AS DOUBLE) AS scale_y", "CAST(8000000 + p_partkey * 100 AS DOUBLE) AS tie_x",
        "CASE WHEN p_partkey % 10 <> 0 THEN CAST(2000000 + p_partkey * 50 AS DOUBLE) END AS tie_y", "256 AS width", "512 AS height",
    )
    r = S.raster_footprint(rows)
    return r.select("part", F.round("maxx", 3).alias("maxx"), F.round("miny", 3).alias("miny"), F.round("west", 6).alias("west"), F.round("north", 6).alias("north"), "resolution")


@register(f"SELECT slice_pos, CAST(5 AS INT) AS corners, min_lon_e7 / 1e7 AS label_x, max_lat_e7 / 1e7 AS label_y, max_lon_e7 / 1e7 AS third_x FROM {SLICES}")
def g04_bbox_ring(spark, sf_dir):
    box = [F.col(c) / 1e7 for c in ("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7")]
    rows = slices(spark, sf_dir).select("slice_pos", S.bbox_ring(*box).alias("ring"), S.label_point(*box).alias("label"))
    return rows.select("slice_pos", F.size("ring").alias("corners"), F.get("label", 0).alias("label_x"), F.get("label", 1).alias("label_y"), F.get(F.get("ring", 2), 0).alias("third_x"))


@register("SELECT CASE WHEN s_suppkey % 7 = 6 THEN concat('rg_', CAST(s_suppkey AS VARCHAR)) ELSE concat(CAST(s_suppkey % 7 AS VARCHAR), '.', CAST(s_suppkey AS VARCHAR)) END AS label, s_acctbal AS minx FROM supplier")
def g05_flatten_extents(spark, sf_dir):
    box = F.struct(F.col("s_acctbal").alias("minx"))
    groups = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 7).alias("f")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("rg_"), F.col("s_suppkey").cast("string")), box))).alias("groups"))
    name = F.when(F.col("f") == 6, F.lit("whole.parquet")).otherwise(F.concat(F.lit("data."), F.col("f").cast("string"), F.lit(".parquet")))
    return S.flatten_extents(groups.select(F.create_map(name, F.col("groups")).alias("extents"))).select("label", "box.minx")


@register("SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_partkey AS VARCHAR) END AS label FROM part")
def g06_part_label(spark, sf_dir):
    name = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('data.', p_size, '.parquet') WHEN 1 THEN concat('rg_', p_partkey) ELSE 'data.parquet' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), S.part_label(name).alias("label"))


@register(f"SELECT pos, split_part(url, '/', 4) || '/' || split_part(url, '/', 5) AS repo, split_part(url, '/', 8) AS tag, split_part(url, '/', 9) AS filename FROM {CATALOG}")
def g07_release_parts(spark, sf_dir):
    return catalog(spark, sf_dir).withColumn("r", S.release_parts(F.col("url"))).select("pos", "r.repo", "r.tag", "r.filename")


@register("SELECT p_partkey AS part, replace(p_name, ' ', '_') AS base FROM part")
def g08_base_name(spark, sf_dir):
    name = F.expr("concat(replace(p_name, ' ', '_'), CASE p_partkey % 3 WHEN 0 THEN '.pmtiles' WHEN 1 THEN '.mosaic.json' ELSE '-part0001.pmtiles' END)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), S.base_name(name).alias("base"))


_REPO = "concat('https://github.com/', split_part(url, '/', 4), '/', split_part(url, '/', 5))"
_TAG = "split_part(url, '/', 8)"


@register(f"""SELECT pos, CASE WHEN type IS DISTINCT FROM 'raster' THEN replace(replace(url, '.mosaic.json', '.parquet'), '.pmtiles', '.parquet') END AS parquet,
CASE WHEN type IS DISTINCT FROM 'raster' THEN replace(replace(url, '.mosaic.json', ''), '.pmtiles', '') || '.parquet.meta.json' END AS meta,
CASE pos % 6 WHEN 0 THEN {_REPO} || '/releases/download/' || {_TAG} || '/' || brand || '.pmtiles' WHEN 1 THEN {_REPO} || '/releases/download/' || brand WHEN 2 THEN 'https://github.com/' || brand
WHEN 3 THEN 'https://other.org/' || brand WHEN 4 THEN 'http://full.org/a/../' || brand ELSE {_REPO} || '/releases/?q=..' END AS slice_url FROM {CATALOG}""")
def g09_parquet_url(spark, sf_dir):
    """URLs beside those of archives that aren't rasters, and keys of all forms relative to them."""
    u, kind, brand = F.col("url"), F.col("type"), F.col("brand")
    forms = (F.concat(F.lit("./x/.././"), brand, F.lit(".pmtiles")), F.concat(F.lit("../"), brand), F.concat(F.lit("/"), brand), F.concat(F.lit("//other.org/"), brand), F.concat(F.lit("http://full.org/a/../"), brand))
    key = F.coalesce(*[F.when(F.col("pos") % 6 == i, f) for i, f in enumerate(forms)], F.lit("../..?q=.."))
    return catalog(spark, sf_dir).select("pos", S.parquet_url(u, kind).alias("parquet"), S.meta_url(u, kind).alias("meta"), S.resolve_url(u, key).alias("slice_url"))


@register(f"SELECT pos, concat('https://github.com/', split_part(url, '/', 4), '/', split_part(url, '/', 5), '/releases/tag/', split_part(url, '/', 8)) AS page FROM {CATALOG}")
def g10_release_page(spark, sf_dir):
    return catalog(spark, sf_dir).select("pos", S.release_page(F.col("url")).alias("page"))


NAMES = ("id", "uuid", "objectid", "id_no", "width", "areacode", "pincode", "key1", "name", "simptol", "foo", "geom_id", "STArea")
SCORES = (100, 95, 80, 75, 60, None, 50, 45, 20, -5, 0, 80, None)


@register("SELECT p_partkey AS part, CASE CAST(p_partkey % 13 AS INT) " + " ".join(f"WHEN {i} THEN CAST({'NULL' if s is None else s} AS INT)" for i, s in enumerate(SCORES)) + " END AS score FROM part")
def g11_id_score(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 13).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), S.id_score(name).alias("score"))


@register("SELECT p_partkey AS part, CAST(levenshtein(p_name, p_type) AS INT) AS edits FROM part")
def g12_edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.levenshtein("p_name", "p_type").alias("edits"))


@register(f"""SELECT pos, concat('see <a href="https://x.org/', split_part(split_part(notes, 'x.org/', 2), ')', 1), '">', brand, '</a> or <a href="https://y.org/', CAST(pos AS VARCHAR), '">https://y.org/', CAST(pos AS VARCHAR), '</a>') AS html FROM {CATALOG} WHERE notes IS NOT NULL""")
def g13_md_to_html(spark, sf_dir):
    return catalog(spark, sf_dir).where("notes is not null").select("pos", S.md_to_html(F.col("notes")).alias("html"))


@register(f"""SELECT pos, concat('<a href="', url, '">', url, '</a>') AS html FROM {CATALOG}""")
def g13_linkify(spark, sf_dir):
    return catalog(spark, sf_dir).select("pos", S.linkify(F.col("url")).alias("html"))


_NOTES = """CASE WHEN doc_id % 5 = 4 THEN 'plain line' ELSE concat(
 'Tiles: https://maps.example.org/d', d, '/{{z}}/{{x}}/{{y}}.pbf', {view}, chr(10), 'see [{text}](https://h/LICENSE) or {url}', chr(10), {data}, chr(10), {alone}, chr(10), 'x.7z.txt') END"""
_OLD = _NOTES.format(view="''", text="old terms", url="https://h/OLD", data="'Data  file d' || d || '.7z:'", alone="'d' || d || CASE WHEN doc_id % 2 = 0 THEN '.7z' ELSE '.zip:' END")
_NEW = _NOTES.format(
    view="' - [view](https://maps.example.org/d' || d || '/view)'", text="new terms", url="https://h/LICENSE", data="'Data file [d' || d || '.7z](https://h/f/d' || d || '.7z)'",
    alone="'### [d' || d || CASE WHEN doc_id % 2 = 0 THEN '.7z' ELSE '.zip' END || '](https://h/f/d' || d || CASE WHEN doc_id % 2 = 0 THEN '.7z)' ELSE '.zip)' END",
)


@register(f"SELECT doc_id, {_NEW} AS new_body, doc_id % 5 <> 4 AS changed FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS d FROM documents)")
def g14_rewrite_notes(spark, sf_dir):
    body = table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(doc_id AS STRING) AS d").selectExpr("doc_id", f"{_OLD} AS body")
    rules = [
        lambda line: notes.add_view_links(line, "https://maps.example.org/"),
        lambda line: notes.fix_license_link(line, "https://h/OLD", "https://h/LICENSE"),
        lambda line: notes.fix_license_text(line, "old terms", "new terms", "https://h/LICENSE"),
        lambda line: notes.add_data_links(line, "https://h/f"),
    ]
    return notes.rewrite_notes(body, rules).select("doc_id", "new_body", "changed")


@register("SELECT p_partkey AS part, CASE WHEN p_partkey % 50 = 0 THEN '0.00 KB' ELSE concat(CAST(CAST(p_size AS DOUBLE) AS VARCHAR), ' ', CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' ELSE 'GB' END) END AS size, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') AS safe, strftime(make_timestamp(p_partkey * 100000 * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM part")
def g15_display(spark, sf_dir):
    size = F.expr("CASE WHEN p_partkey % 50 = 0 THEN 0L ELSE p_size * shiftleft(1L, CAST(10 * (p_partkey % 4) AS INT)) END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), S.readable_size(size).alias("size"), S.safe_name(F.col("p_name")).alias("safe"), S.epoch_iso(F.col("p_partkey") * 100000).alias("iso"))
