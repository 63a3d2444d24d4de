"""Queries: catalog, items and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets as A
from ..operators import catalog as C
from ..operators import profiles, stac
from ..sources import readers
from .feature_queries import PICKED, _profiled
from .inputs import ASSETS, CATALOG, ITEMS, SLICES, assets, catalog, items, slices, table
from .registry import Registry

REGISTRY = register = Registry()


@register(f"SELECT route, name, coalesce(type, 'vector') AS type, CASE WHEN coalesce(type, 'vector') = 'raster' THEN 'webp' ELSE 'pbf' END AS tilesuffix, CASE WHEN pos % 2 = 0 THEN 2 ELSE 1 END AS categories, coalesce(partitioned_parquet, false) AS partitioned FROM {CATALOG}")
def src05_read_catalog(spark, sf_dir):
    """Each brand's sources as a catalog document, read back as rows."""
    c = catalog(spark, sf_dir)
    entry = lambda category: F.struct("name", "type", "url", "handlertype", "license", "partitioned_parquet", category.alias("category"))
    many, one = F.to_json(entry(F.array("brand", "ptype"))), F.to_json(entry(F.col("brand")))
    text = c.select("brand", F.concat(F.to_json(F.array("route")), F.when(F.col("pos") % 2 == 0, many).otherwise(one)).alias("e"))
    pairs = F.transform(F.collect_list("e"), lambda e: F.regexp_replace(e, r'^\["((?:[^"\\]|\\.)*)"\]', '"$1":'))
    documents = text.groupBy("brand").agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("value"))
    rows = readers.catalog_rows(documents)
    return rows.select("route", "name", "type", "tilesuffix", F.size("categories").alias("categories"), F.col("partitioned_parquet").alias("partitioned"))


@register(f"SELECT pos, route FROM {CATALOG} WHERE type IS DISTINCT FROM 'raster'")
def f14_vector_sources(spark, sf_dir):
    return C.vector_sources(catalog(spark, sf_dir)).select("pos", "route")


@register(f"SELECT pos, route FROM {CATALOG} WHERE type = 'raster'")
def f14_raster_sources(spark, sf_dir):
    return C.raster_sources(catalog(spark, sf_dir)).select("pos", "route")


@register(f"SELECT pos FROM {CATALOG} WHERE lower(brand) IN ('brand#12', 'brand#23') OR lower(ptype) IN ('brand#12', 'brand#23')")
def f15_category_any(spark, sf_dir):
    return C.category_any(catalog(spark, sf_dir), ["BRAND#12", "brand#23"]).select("pos")


@register(f"SELECT pos FROM {CATALOG} WHERE ptype = (SELECT min(p_type) FROM part) AND brand IN (SELECT min(p_brand) FROM part)")
def f16_category_all(spark, sf_dir):
    least = table(spark, sf_dir, "part").agg(F.min("p_type"), F.min("p_brand")).first()
    return C.category_all(catalog(spark, sf_dir), [least[0], least[1]]).select("pos")


_WORDS = "list_filter(regexp_split_to_array(translate(lower({c}), '-_', '  '), '\\s+'), lambda w: w <> '')"
_FUZZY = "(contains(lower({c}), '{q}') OR len(list_filter(" + _WORDS + ", lambda w: levenshtein(w, '{q}') <= least(2, length(w) // 3 + 1))) > 0)"
QUERY = "wigdet"


@register(f"SELECT pos FROM {CATALOG} WHERE {_FUZZY.format(c='name', q=QUERY)} OR {_FUZZY.format(c='route', q=QUERY)}")
def f17_fuzzy_search(spark, sf_dir):
    return C.fuzzy_search(catalog(spark, sf_dir), QUERY).select("pos")


@register(f"SELECT pos FROM {CATALOG} WHERE contains(lower(name), '#1') OR contains(lower(route), '#1') OR contains(lower(coalesce(notes, '')), '#1') OR contains(lower(brand), '#1') OR contains(lower(ptype), '#1')")
def f18_text_search(spark, sf_dir):
    return C.text_search(catalog(spark, sf_dir), "#1").select("pos")


@register(f"SELECT 'number' AS how, pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS r FROM {CATALOG} WHERE type IS DISTINCT FROM 'raster') WHERE r = 17 UNION ALL SELECT 'route', min(pos) FROM {CATALOG} WHERE pos = 13 UNION ALL SELECT 'name', min(pos) FROM {CATALOG} WHERE type IS DISTINCT FROM 'raster' AND name = (SELECT p_name FROM part WHERE p_partkey = 31)")
def f19_resolve_source(spark, sf_dir):
    c = catalog(spark, sf_dir)
    known = {r["pos"]: r for r in c.where("pos in (13, 31)").select("pos", "route", "name").collect()}
    found = [C.resolve_source(c, text).select(F.lit(how).alias("how"), "pos") for how, text in (("number", "17"), ("route", known[13]["route"]), ("name", known[31]["name"]))]
    return A.concat(found)


@register("SELECT page_id FROM pages WHERE url LIKE 'https://www.%' OR url LIKE 'http://blog.%'")
def f20_url_allowed(spark, sf_dir):
    return C.url_allowed(table(spark, sf_dir, "pages"), ["https://www.", "http://blog."]).select("page_id")


@register(f"SELECT pos, route FROM {CATALOG} WHERE route NOT LIKE '/%'")
def f21_lint_routes(spark, sf_dir):
    return C.lint_routes(catalog(spark, sf_dir)).select("pos", "route")


@register(f"""SELECT c.route, CAST(json_array_length(b, '$') AS BIGINT) AS numbers, lo / 1e7 AS west, CASE WHEN license IS NULL THEN 'Source: ' || name ELSE 'Source: ' || name || ' | License: ' || license END AS attribution, 'application/x-protobuf' AS mime
FROM (SELECT *, '[1,2,3,4]' AS b FROM {CATALOG}) c JOIN (SELECT slice_pos, min_lon_e7 AS lo FROM {SLICES}) s ON s.slice_pos = c.pos""")
def f24_tilejson(spark, sf_dir):
    c = catalog(spark, sf_dir)
    headers = slices(spark, sf_dir).join(c.select("route", F.col("pos").alias("slice_pos")), "slice_pos").withColumn("tile_type", F.lit(1))
    rows = C.tilejson(c, headers)
    get = lambda p: F.get_json_object("tilejson", p)
    return rows.select("route", F.json_array_length(get("$.bounds")).cast("bigint").alias("numbers"), get("$.bounds[0]").cast("double").alias("west"), get("$.attribution").alias("attribution"), "mime")


@register(f"SELECT category, count(*) AS n FROM (SELECT lower(brand) AS category FROM {CATALOG} UNION ALL SELECT lower(ptype) FROM {CATALOG}) GROUP BY category")
def a05_category_counts(spark, sf_dir):
    return C.category_counts(catalog(spark, sf_dir))


@register(f"SELECT category, count(*) AS n FROM (SELECT brand AS category FROM {CATALOG} UNION ALL SELECT ptype FROM {CATALOG}) GROUP BY category ORDER BY n DESC, category")
def o01_order_categories(spark, sf_dir):
    return C.order_categories(C.category_counts(catalog(spark, sf_dir), fold_case=False))


@register(f"SELECT pos, name FROM {CATALOG} ORDER BY name, route")
def o02_order_catalog(spark, sf_dir):
    return C.order_catalog(catalog(spark, sf_dir), "UNICODE").select("pos", F.collate("name", "UTF8_BINARY").alias("name"))


@register(f"SELECT pos, CAST(r AS INT) AS number FROM (SELECT pos, brand, row_number() OVER (ORDER BY pos) AS r FROM {CATALOG} WHERE type IS DISTINCT FROM 'raster') WHERE brand = 'Brand#11'")
def w03_source_number(spark, sf_dir):
    return C.category_any(C.with_source_number(catalog(spark, sf_dir)), ["brand#11"]).select("pos", "number")


def _stac(spark, sf_dir):
    """Orders as item tables of two collections, read as items."""
    i = items(spark, sf_dir)
    box = F.struct(F.col("w").alias("xmin"), F.col("s").alias("ymin"), F.col("e").alias("xmax"), F.col("n").alias("ymax"))
    raw = i.select("collection_pos", F.col("item_pos").alias("pos"), F.when(~F.col("id").startswith("item-"), F.col("id")).alias("id"), F.when(F.col("version") != "1.0.0", F.col("version")).alias("version"), box.alias("bbox"))
    each = [readers.stac_items(raw.where(F.col("collection_pos") == k), f"c{k}").withColumn("collection_pos", F.lit(k)) for k in (0, 1)]
    return A.concat(each)


@register(f"SELECT item_pos, collection, id, version AS stac_version, w AS ring_x, n AS ring_y FROM {ITEMS}")
def src08_stac_items(spark, sf_dir):
    corner = F.get(F.get("ring", 0), 3)
    return _stac(spark, sf_dir).select("item_pos", "collection", "id", "stac_version", F.get(corner, 0).alias("ring_x"), F.get(corner, 1).alias("ring_y"))


@register("""SELECT CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS pos, s_name AS id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'T ' || s_name END, s_name) AS title, 'd' || CAST(s_suppkey AS VARCHAR) || '.parquet' AS geoparquet
FROM supplier QUALIFY s_suppkey % 3 <> 0""")
def src11_collections(spark, sf_dir):
    """A catalog for each nation: its suppliers as links."""
    key = F.col("s_suppkey")
    link = F.struct(
        F.when(key % 3 == 0, "self").otherwise("child").alias("rel"), F.concat(F.lit("./"), "s_name", F.lit("/")).alias("href"),
        F.when(key % 2 == 0, F.concat(F.lit("T "), "s_name")).alias("title"), F.concat(F.lit("d"), key.cast("string"), F.lit(".parquet")).alias("geoparquet"),
    )
    links = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", link.alias("link")))), lambda s: s["link"])
    text = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(links.alias("links"))).alias("value"))
    return readers.collection_rows(text).select("pos", "id", "title", "geoparquet")


@register(f"SELECT collection, id, w FROM {ITEMS} WHERE collection = 'c1' AND id = (SELECT max(id) FROM {ITEMS} WHERE collection = 'c1')")
def f26_stac_item(spark, sf_dir):
    found = _stac(spark, sf_dir)
    last = found.where("collection = 'c1'").agg(F.max("id")).first()[0]
    return stac.stac_item(found, "c1", last).select("collection", "id", F.get("bbox", 0).alias("w"))


@register(f"SELECT id FROM {ITEMS} WHERE w <= 80 AND e >= 75 AND s <= 20 AND n >= 12")
def f27_stac_bbox(spark, sf_dir):
    return stac.stac_bbox(_stac(spark, sf_dir), (75, 12, 80, 20)).select("id")


@register(f"SELECT id FROM {ITEMS} WHERE collection = 'c0' ORDER BY item_pos LIMIT 10 OFFSET 20")
def o03_page(spark, sf_dir):
    return stac.page(_stac(spark, sf_dir).where("collection = 'c0'"), "item_pos", 10, 20).select("id")


@register(f"SELECT id FROM {ITEMS} WHERE w <= 80 AND e >= 75 AND s <= 20 AND n >= 12 ORDER BY collection_pos, item_pos LIMIT 25")
def o04_stac_search(spark, sf_dir):
    return stac.stac_search(_stac(spark, sf_dir), ["c0", "c1", "unknown"], (75, 12, 80, 20), 25).select("id")


_CLASS = """CASE WHEN regexp_matches(asset, '(?i)\\.geojsonl\\.7z(\\.\\d{3})?$') THEN 'archive' WHEN asset LIKE '%.parquet.meta.json' THEN 'meta' WHEN asset LIKE '%.analysis.json' THEN 'analysis'
WHEN regexp_matches(asset, '\\.\\d+\\.parquet$') THEN 'part' WHEN asset LIKE '%.parquet' THEN 'parquet' WHEN regexp_matches(asset, '-part\\d+\\.pmtiles$') THEN 'tiles_part' WHEN asset LIKE '%.pmtiles' THEN 'tiles' WHEN asset LIKE '%.mosaic.json' THEN 'mosaic' END"""
COUNTED = f"SELECT repo, tag, base, " + ", ".join(f"CAST(count(*) FILTER (WHERE class = '{c}') AS BIGINT) AS {c}" for c, _ in A.CLASSES) + f" FROM (SELECT *, {_CLASS} AS class FROM {ASSETS}) GROUP BY repo, tag, base"
_KEYS = "concat('org/repo', CAST(p_partkey % 4 AS VARCHAR)) AS repo, concat('v', CAST(p_size % 3 AS VARCHAR)) AS tag, concat(replace(p_name, ' ', '_'), '-', CAST(p_partkey AS VARCHAR)) AS base"


@register(f"SELECT p_partkey AS pos, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c, _ in A.CLASSES) + f" FROM (SELECT p_partkey, {_KEYS} FROM part) p LEFT JOIN ({COUNTED}) a USING (repo, tag, base)")
def j05_match_assets(spark, sf_dir):
    return A.match_assets(catalog(spark, sf_dir), assets(spark, sf_dir)).select("pos", *[c for c, _ in A.CLASSES])


@register("SELECT p_partkey AS part FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 9 <> 0)")
def j06_skip_done(spark, sf_dir):
    todo = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    done = todo.where("part % 3 = 0").withColumn("error", F.when(F.col("part") % 9 == 0, "failed"))
    return A.skip_done(todo, done, ["part"])


@register(f"SELECT dataset, coalesce(picked, promoteid) AS promoteid FROM ({PICKED}) RIGHT JOIN (SELECT unnest(['customer', 'orders', 'part', 'events', 'other']) AS dataset, 'fid' AS promoteid, count(*) AS c FROM orders) USING (dataset)")
def j07_apply_ids(spark, sf_dir):
    cat = spark.createDataFrame([(d, "fid") for d in ("customer", "orders", "part", "events", "other")], "route string, promoteid string")
    picks = profiles.pick_ids(_profiled(spark, sf_dir)).select(F.col("dataset").alias("route"), "picked")
    return A.apply_ids(cat, picks).select(F.col("route").alias("dataset"), "promoteid")


@register(f"SELECT repo, tag, base, part AS parts FROM ({COUNTED}) WHERE part > 1")
def a11_partitioned_bases(spark, sf_dir):
    return A.partitioned_bases(assets(spark, sf_dir))


@register(f"SELECT pos, partitioned_parquet OR (type IS DISTINCT FROM 'raster' AND handlertype IN ('pmtiles', 'mosaic') AND pos % 18 = 0) AS partitioned FROM {CATALOG}")
def j08_mark_partitioned(spark, sf_dir):
    return A.mark_partitioned(catalog(spark, sf_dir), assets(spark, sf_dir)).select("pos", F.col("partitioned_parquet").alias("partitioned"))


@register("SELECT CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE p_name END AS name, '/' || CAST(p_partkey AS VARCHAR) AS route FROM part UNION ALL SELECT 'new', '/x' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 100 = 0")
def j09_upsert_routes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cat = part.selectExpr("concat('/', p_partkey) AS route", "p_name AS name")
    entries = part.where("p_partkey % 10 = 0").selectExpr("concat('/', p_partkey) AS route", "'new' AS name").union(part.where("p_partkey % 100 = 0").selectExpr("concat('/x', p_partkey)", "'new'"))
    return A.upsert_routes(cat, entries).select("name", "route")


@register("SELECT '/' || CAST(p_partkey AS VARCHAR) AS route, CASE WHEN p_partkey % 4 = 0 THEN 'cli' WHEN p_partkey % 3 = 0 THEN 'f' || CAST(p_partkey AS VARCHAR) END AS promoteid FROM part")
def j09_entry_promoteid(spark, sf_dir):
    """Explicit identifiers, picked ones, and neither."""
    part = table(spark, sf_dir, "part")
    entries = part.selectExpr("concat('/', p_partkey) AS route", "CASE WHEN p_partkey % 4 = 0 THEN 'cli' WHEN p_partkey % 2 = 0 THEN '' END AS promoteid")
    analysis = part.selectExpr("concat('/', p_partkey) AS route", "CASE WHEN p_partkey % 3 = 0 THEN concat('f', p_partkey) ELSE '' END AS field")
    return A.with_promoteid(entries, analysis)


@register(f"SELECT DISTINCT asset FROM {ASSETS} WHERE asset LIKE '%.parquet' OR asset LIKE '%.pmtiles'")
def u01_add_assets(spark, sf_dir):
    a = assets(spark, sf_dir).select("asset")
    return A.add_assets(a.where("asset LIKE '%.parquet'"), a.where("asset LIKE '%.pmtiles' OR asset LIKE '%.0.parquet'"))


@register(f"SELECT DISTINCT asset FROM {ASSETS} WHERE (asset LIKE '%.parquet' AND asset NOT LIKE '%.0.parquet') OR asset LIKE '%.txt'")
def u02_change_assets(spark, sf_dir):
    a = assets(spark, sf_dir).select("asset")
    return A.change_assets(a.where("asset LIKE '%.parquet'"), a.where("asset LIKE '%.txt'").union(spark.createDataFrame([(" ",)], "asset string")), a.where("asset LIKE '%.0.parquet'"))


@register("SELECT c_custkey AS key, c_name AS name, CAST(NULL AS VARCHAR) AS mark FROM customer UNION ALL SELECT s_suppkey, s_name, 's' FROM supplier")
def u03_concat(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "'s' AS mark")
    return A.concat([c, s])
