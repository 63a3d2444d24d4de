"""Feature filters, inference, repair, partitions and streams on small cases."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import scalars as S
from geoloom.operators import catalog as C
from geoloom.operators import filters, joins, partitioning, profiles, schema
from geoloom.plans import inputs
from geoloom.sources import readers, sinks
from geoloom.streaming import features as stream

SQUARE = [[(77.0, 12.0), (78.0, 12.0), (78.0, 13.0), (77.0, 13.0), (77.0, 12.0)]]


def feature(kind, coordinates, **props):
    return json.dumps({"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": props})


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, line string")


def shapes(spark, *texts):
    df = lines(spark, *texts)
    g = F.get_json_object("line", "$.geometry")
    df = df.withColumn("geom_type", F.get_json_object(g, "$.type")).withColumn("coords", G.coords_from_json(g))
    return df.withColumn("bbox", G.bbox(F.col("coords")))


def test_bbox_and_polygon_keep_one_of_two_points(spark):
    df = shapes(spark, feature("Point", [77.5946, 12.9716]), feature("Point", [78.4867, 17.385]))
    assert [r["n"] for r in filters.bbox_filter(df, "77,12,78,13").collect()] == [0]
    assert [r["n"] for r in filters.shape_filter(df, SQUARE).collect()] == [0]


@pytest.mark.parametrize(
    ("kind", "coordinates", "meets"),
    [
        ("LineString", [[76, 12.5], [79, 12.5]], True),
        ("LineString", [[76, 11], [79, 11.5]], False),
        ("LineString", [[76, 12], [77, 12]], True),
        ("Polygon", [[[70, 5], [90, 5], [90, 20], [70, 20], [70, 5]]], True),
        ("Polygon", [[[70, 5], [90, 5], [90, 20], [70, 20], [70, 5]], [[76, 11], [79, 11], [79, 14], [76, 14], [76, 11]]], False),
        ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[77.2, 12.2], [77.4, 12.2], [77.4, 12.4], [77.2, 12.2]]]], True),
        ("MultiPoint", [[0, 0], [77, 12]], True),
        ("MultiLineString", [[[0, 0], [1, 1]], [[77.5, 11], [77.5, 14]]], True),
    ],
)
def test_intersects(spark, kind, coordinates, meets):
    assert bool(filters.shape_filter(shapes(spark, feature(kind, coordinates)), SQUARE).count()) is meets


@pytest.mark.parametrize("bounds", ["1,2,3", "5,0,1,2", "-190,0,1,2", "0,0,0,1", "a,b,c,d"])
def test_bad_bounds(bounds):
    with pytest.raises(ValueError):
        filters.parse_bounds(bounds)


def layer(spark):
    squares = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[k, k], [k + 5, k], [k + 5, k + 5], [k, k + 5], [k, k]]]}, "properties": {"filter_id": n, "value": v, "common_key": "common_value"}} for k, n, v in ((0, "first", 1), (5, "second", 2), (10, "third", 3), (15, "fourth", 100))]
    squares.insert(1, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {}})
    return readers.filter_layer_rows(spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": squares}),)], "value string"))


def test_picking(spark):
    rows = layer(spark)
    assert [r["pos"] for r in rows.orderBy("pos").collect()] == [0, 1, 2, 3]
    assert filters.pick_by_index(rows, 1).first()["properties"]["filter_id"] == "second"
    for pairs, pos in ((["filter_id=first"], 0), (["value=100"], 3), (["value=3", "common_key=common_value"], 2), (["absent=None", "value=2"], 1)):
        assert filters.pick_by_kv(rows, pairs).first()["pos"] == pos
    for bad in (lambda: filters.pick_by_index(rows, 99), lambda: filters.pick_by_kv(rows, ["value=999"]), lambda: filters.pick_by_kv(rows, ["common_key=common_value"]), lambda: filters.pick_by_kv(rows, ["x"])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    ("values", "kind"),
    [(["a", "b"], "str"), ([1, None], "int"), ([1.5, None], "float"), ([1, "x"], "str"), ([1.5, "x"], "str"), ([1, 1.5], "float"), ([1, 2.2, None], "float"), ([None, None], "str"), ([True, False], "bool"), ([[1], [2]], "list"), ([{"a": 1}], "dict"), ([1.0], "float")],
)
def test_inference(spark, values, kind):
    df = lines(spark, *[feature("Point", [1, 2], name=v) for v in values])
    assert {r["key"]: r["type"] for r in schema.infer_properties(df, order="n").collect()} == {"name": kind}


def test_case_duplicates_and_order(spark):
    df = lines(spark, feature("Point", [1, 2], Rd_Name="a"), feature("Polygon", [[[1, 2]]], Rd_name="b"))
    types, renames = schema.schema_of(df)
    assert list(types) == ["Rd_Name", "Rd_name_2"] and renames == {"Rd_name": "Rd_name_2"}
    assert schema.geometry_types(df).first()["geometry_types"] == ["Point", "Polygon"]
    assert schema.case_renames(["a", "A", "a_2", "A_2"]) == {"A": "A_2", "a_2": "a_2_2", "A_2": "A_2_3"} or schema.case_renames(["a", "A"]) == {"A": "A_2"}


def test_normalise(spark):
    df = spark.createDataFrame([('{"name":"a","code":1}',), ('{"name":"b","category":"c"}',), (None,)], "properties string")
    rows = filters.normalize_props(df, {"name": "str", "code": "int", "category": "str"}).select("properties.*").collect()
    assert [tuple(r) for r in rows] == [("a", 1, None), ("b", None, "c"), (None, None, None)]
    assert filters.normalize_props(df, {}).columns == ["properties"]


def test_scan_marks_bad_lines(spark, tmp_path):
    path = tmp_path / "f.geojsonl"
    path.write_text(feature("Point", [1, 2]) + "\n{broken\n\n" + feature("Point", [3, 4]))
    df = readers.read_geojsonl(spark, str(path))
    assert sorted(r["is_bad"] for r in df.collect()) == [False, False, True, True]


@pytest.mark.parametrize(
    ("lon", "lat", "want"),
    [
        (77.5, 12.9, (77.5, 12.9, "kept")), (12.9, 77.5, (77.5, 12.9, "swapped")), (775.0, 12.9, (77.5, 12.9, "decimal")),
        (12.9, 775.0, (77.5, 12.9, "swapped+decimal")), (50.0, 50.0, None), (0.0, 200.0, None), (1e16, 12.0, None),
    ],
)
def test_repair(spark, lon, lat, want):
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double").withColumn("coords", F.array(F.array(F.array(F.array("lon", "lat", F.lit(7.0))))))
    rows = filters.repair_coords(df).collect()
    if want is None:
        assert rows == []
    else:
        assert rows[0]["coords"][0][0][0] == [*want[:2], 7.0] and rows[0]["rules"] == [r for r in want[2:] if r != "kept"]


def test_geom_renames_leave_the_geometry_alone(spark):
    texts = [
        json.dumps({"type": "Feature", "id": "a\"b", "bbox": [1.5, 2], "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"geometry": {"geom": 1}, "n": 1.0, "s": 'x "geometry": y', "Geom_area": None, "t": True}}),
        feature("Point", [1, 2], name="geom"), feature("Point", [1, 2], Geom_area=5), "{broken", "",
    ]
    rows = [r["line"] for r in filters.rename_geom_props(lines(spark, *texts)).orderBy("n").collect()]
    first, want = json.loads(rows[0]), json.loads(texts[0])
    assert first["properties"] == {"geom_renamed_1": {"geom": 1}, "n": 1.0, "s": 'x "geometry": y', "geom_renamed_2": None, "t": True}
    assert {k: v for k, v in first.items() if k != "properties"} == {k: v for k, v in want.items() if k != "properties"}
    assert list(first["properties"]) == ["geom_renamed_1", "n", "s", "geom_renamed_2", "t"]
    assert rows[1] == texts[1] and json.loads(rows[2])["properties"] == {"geom_renamed_2": 5} and rows[3:] == texts[3:]


def test_geom_renames_parse_an_object_once(spark):
    texts = [
        json.dumps({"type": "Feature\t\\ \u0001\u007f\u2028é", "geometry": None, "properties": {"geom": '{"a": "b\\n"}', 'geom"x\\y': "\n", "n": [1, "geom"], "e": "", "中": "true"}}),
        json.dumps({"type": "Feature", "properties": '{"geom": 1}'}), feature("Point", [1, 2], other="geom"), None,
        '{"properties":{"geom":"a\tb"}}', '{"properties":{"geom":NaN}}', '{"geometry":NaN,"properties":{"geom":1}}', '{"properties":{"geom":1},"n":',
    ]
    df = filters.rename_geom_props(lines(spark, *texts))
    # kinds were looked up in a map that was parsed anew for each member
    assert "element_at(from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = [r["line"] for r in df.orderBy("n").collect()]
    want = json.loads(texts[0])
    want["properties"] = {{"geom": "geom_renamed_1", 'geom"x\\y': "geom_renamed_2"}.get(k, k): v for k, v in want["properties"].items()}
    assert json.loads(rows[0]) == want and list(json.loads(rows[0])["properties"]) == list(want["properties"])
    assert json.loads(rows[1]) == json.loads(texts[1])  # a text that looks like an object stays a text
    assert rows[2:] == texts[2:]  # lines that aren't JSON stay, also where a part of them could be read


def test_release_notes(spark):
    from geoloom.operators import notes

    def one(rule, text):
        return spark.createDataFrame([(text,)], "t string").select(rule(F.col("t"))).first()[0]

    view = lambda line: notes.add_view_links(line, "https://m.example.org/")
    assert one(view, "Tiles: https://m.example.org/a/b/{z}/{x}/{y}.pbf now") == "Tiles: https://m.example.org/a/b/{z}/{x}/{y}.pbf - [view](https://m.example.org/a/b/view) now"
    assert one(view, "https://m.example.org/a/{z}/{x}/{y}.pbf") == "https://m.example.org/a/{z}/{x}/{y}.pbf"
    data = lambda line: notes.add_data_links(line, "https://h")
    cases = {"foo.7z": "### [foo.7z](https://h/foo.7z)", " Data  file foo.7z: ": "Data file [foo.7z](https://h/foo.7z)", "foo.zip:": "### [foo.zip](https://h/foo.zip)", "foo.zip": "foo.zip", "  x ": "x"}
    assert {t: one(data, t) for t in cases} == cases
    assert one(lambda c: notes.fix_license_text(c, "old", "new", "u"), "[old](u) old") == "[new](u) old"


def test_numbers_beyond_64_bits(spark):
    texts = ['{"properties":{"a":12345678901234567890,"b":1.0,"c":12345678901234567890.0,"d":1e3,"e":-0}}', "{broken", '{"properties":null}']
    assert {r["key"]: r["type"] for r in schema.infer_properties(lines(spark, *texts), order="n").collect()} == {"a": "int", "b": "float", "c": "float", "d": "float", "e": "int"}


def test_item_tables_by_position(spark, tmp_path):
    path = str(tmp_path / "items")
    kind = "a string, b map<string,string>, c struct<xmin:double,ymin:double,xmax:double,ymax:double>, d binary, e string, f array<string>, g string, h string, i string, j bigint, k array<bigint>, l array<double>"
    rows = [("x", None, (1.0, 2.0, 3.0, 4.0), None, None, None, "", "Feature", "2020", 1, [2], [0.5]), (None, {"q": "r"}, None, None, None, ["s"], "1.1.0", "Feature", None, None, None, None), ("", None, None, None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(path)
    got = readers.read_stac_items(spark, path, "c").orderBy("item_pos").collect()
    assert [(r["item_pos"], r["id"], r["stac_version"]) for r in got] == [(0, "x", "1.0.0"), (1, "item-1", "1.1.0"), (2, "item-2", "1.0.0")]
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        readers.read_stac_items(spark, str(tmp_path / "other"), "c")


def test_a_filtered_line_has_its_coordinates_worked_out_once(spark):
    df = lines(spark, feature("Point", [77.5, 12.5], a=1), feature("Point", [70, 12.5], a=2), '{"type":"Feature","geometry":null}', "{broken")
    found = stream.filter_lines(df, SQUARE, {"a": "int"})
    assert [r["a"] for r in found.select("properties.*").collect()] == [1]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


def test_slices_of_one_extent_meet_tiles_once(spark, monkeypatch):
    same = spark.range(500).selectExpr("500 - id AS slice_pos", "concat('s', id) AS slice", "0L AS min_lon_e7", "0L AS min_lat_e7", "450000000L AS max_lon_e7", "450000000L AS max_lat_e7", "3 AS min_zoom", "3 AS max_zoom")
    seen = []
    monkeypatch.setattr(joins, "_finest", lambda slices: seen.append(slices.count()) or 3)
    tile = spark.createDataFrame([(3, 4, 3)], "z int, x bigint, y bigint")
    for symmetric in (False, True):
        assert [r["slice"] for r in joins.tile_to_slice(tile, same, symmetric).collect()] == ["s499"]
    assert seen == [1, 1]


def test_large_collections_become_several(spark, tmp_path):
    p = inputs.points(spark, "/root/testdata/sf0.001").withColumn("geometry", sinks.geometry_json()).select("id", "geometry")
    path = str(tmp_path / "c")
    sinks.write_geojson(p, path, shards=2, most=10_000)
    sizes = [os.path.getsize(f) for f in _files(path)]
    assert len(sizes) > 2 and max(sizes) < 15_000
    docs = [json.loads(open(f).read()) for f in _files(path)]
    assert sorted(f["properties"]["id"] for d in docs for f in d["features"]) == sorted(r["id"] for r in p.collect())
    sinks.write_geojson(p, path, shards=2)
    assert len(_files(path)) == 2


def test_items_are_numbered_over_files(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = spark.range(100).repartitionByRange(3, "id").sortWithinPartitions("id")
    rows.selectExpr("cast(null AS string) AS a", "cast(null AS map<string, string>) AS b", "named_struct('xmin', 1D, 'ymin', 2D, 'xmax', 3D, 'ymax', 4D) AS c", *[f"cast(null AS string) AS {c}" for c in "defg"], "'Feature' AS h", "cast(id AS string) AS i", *[f"cast(null AS string) AS {c}" for c in "jkl"]).write.parquet(path)
    got = readers.read_stac_items(spark, path, "c").select("item_pos", "id", "datetime").collect()
    assert sorted(r["item_pos"] for r in got) == list(range(100))
    assert all(r["id"] == f"item-{r['datetime']}" and int(r["datetime"]) == r["item_pos"] for r in got)


def _files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_ino for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_only_leaves_beyond_the_limit_are_written_again(spark, tmp_path, monkeypatch):
    p = inputs.points(spark, "/root/testdata/sf0.01").select("id", "bbox")
    path = str(tmp_path / "p")
    # a text in one corner alone makes rows there larger than the sample tells
    corner = p.withColumn("note", F.when((F.col("bbox.xmin") < 75) & (F.col("bbox.ymin") < 12), F.sha2(F.col("id").cast("string"), 512)))
    written = []
    write = partitioning.write_partitioned

    def spy(df, to, *args, **kwargs):
        before = _files(path) if written else {}
        write(df, to, *args, **kwargs)
        written.append((kwargs.get("mode", "overwrite"), before))

    monkeypatch.setattr(partitioning, "write_partitioned", spy)
    leaves = partitioning.write_bounded(corner, path, 60_000)
    stored = readers.read_features(spark, path)
    assert leaves > 1 and partitioning.oversized(spark, path, 60_000).isEmpty()
    assert sorted(r["id"] for r in stored.select("id").collect()) == sorted(r["id"] for r in p.select("id").collect())
    assert len(written) > 1 and all(mode == "append" for mode, _ in written[1:])
    depths = {int(r["kd_leaf"]).bit_length() for r in stored.select("kd_leaf").distinct().collect()}
    assert len(depths) > 1
    kept = set(written[1][1]) & set(_files(path))
    assert kept and all(_files(path)[f] == written[1][1][f] for f in kept)


def test_a_hot_point_is_cut_by_rows(spark, tmp_path):
    p = inputs.points(spark, "/root/testdata/sf0.001").select("id", F.struct(*[F.lit(1.0).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("bbox"))
    path = str(tmp_path / "hot")
    assert partitioning.write_bounded(p, path, 3_000) > 1 and partitioning.oversized(spark, path, 3_000).isEmpty()
    assert readers.read_features(spark, path).select("id").distinct().count() == p.count()
    # one row beyond the limit stays, and so does an empty table
    assert partitioning.write_bounded(p.limit(1), str(tmp_path / "one"), 10) == 1
    assert partitioning.write_bounded(p.limit(0), str(tmp_path / "none"), 10) == 0


def test_one_leaf_is_written_by_many_tasks_along_a_curve(spark, tmp_path):
    p = inputs.points(spark, "/root/testdata/sf0.01").select("id", "bbox").withColumn("kd_leaf", F.lit(1))
    path = str(tmp_path / "leaf")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    partitioning.write_partitioned(p, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = readers.read_features(spark, path).groupBy(F.input_file_name()).agg(*[f(f"bbox.{c}").alias(n) for f, c, n in ((F.min, "xmin", "w"), (F.max, "xmin", "e"), (F.min, "ymin", "s"), (F.max, "ymin", "n"))]).collect()
    # compact parts: strips over one axis would be 31 / 16 + 33 degrees each
    assert len(files) == 16 and sum(r["e"] - r["w"] + r["n"] - r["s"] for r in files) / 16 < 28


def test_hilbert_curve(spark):
    rows = [(i * 16 + j, (i + 0.5) / 16 * 360 - 180, (j + 0.5) / 16 * 180 - 90) for i in range(16) for j in range(16)]
    box = F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    got = sorted((r["d"], r["id"] // 16, r["id"] % 16) for r in spark.createDataFrame(rows, "id int, x double, y double").select("id", partitioning.curve(box, 4).alias("d")).collect())
    assert [g[0] for g in got] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("n, blocks", [(0, 1), (1, 8), (200, 1), (300, 2), (400, 32)])
def test_shards_are_packed_in_order_within_the_limit(spark, n, blocks):
    rng = random.Random(n)
    tiles = [(z, x, y) for z in range(4, 7) for x in range(16) for y in range(16)]
    rng.shuffle(tiles)
    sized = [(z, x, y, rng.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000, rng.randint(0, 60), None])) for z, x, y in tiles[:n]]
    got = {(r["z"], r["x"], r["y"]): r["shard"] for r in partitioning.pack_shards(spark.createDataFrame(sized, "z int, x int, y int, bytes bigint"), 100, blocks=blocks).collect()}
    want, used, shard = {}, None, -1
    for z, x, y, b in sorted(sized, key=lambda t: t[:3]):
        if used is None or used + (b or 0) > 100:
            shard, used = shard + 1, b or 0
        else:
            used += b or 0
        want[z, x, y] = shard
    assert got == want


def test_kd_plan_grows_by_an_expression_a_round(spark):
    p = inputs.points(spark, "/root/testdata/sf0.001")
    plan = partitioning.kd_partition(p, 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and len(plan) < 60_000


def test_spatial_join_of_boxes_of_all_sizes(spark):
    import random

    rng = random.Random(5)

    def boxes(n):
        out = []
        for i in range(n):
            side = rng.choice((0, 0.001, 0.3, 2, 20, 150))
            x, y = rng.uniform(-180, 180 - side), rng.uniform(-90, 90 - min(side, 170))
            out.append((i, round(x, 3), round(y, 3), round(x + side, 3), round(y + min(side, 170), 3)))
        return out

    def table(rows):
        df = spark.createDataFrame(rows, "id int, w double, s double, e double, n double")
        p = lambda x, y: F.array(F.col(x), F.col(y))
        df = df.withColumn("coords", F.array(F.array(F.array(p("w", "s"), p("e", "s"), p("e", "n"), p("w", "n"), p("w", "s"))))).withColumn("geom_type", F.lit("Polygon"))
        return df.withColumn("bbox", G.bbox(F.col("coords"))).withColumn("edges", G.edges(F.col("coords")))

    a, b = boxes(120), boxes(60)
    got = sorted((r["id"], r["polygon_id"]) for r in joins.spatial_join(table(a), table(b).withColumnRenamed("id", "polygon_id")).collect())
    want = sorted((i, j) for i, w, s, e, n in a for j, x, y, z, t in b if w <= z and e >= x and s <= t and n >= y)
    assert got == want
    semi = joins.spatial_join(table(a), table(b).withColumnRenamed("id", "polygon_id"), how="left_semi")
    assert sorted(r["id"] for r in semi.collect()) == sorted({i for i, _ in want})


@pytest.mark.parametrize("symmetric", [False, True])
def test_tiles_and_slices_of_any_size(spark, symmetric):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(80):
        w, s = rng.randrange(-170, 170), rng.randrange(-80, 80)
        side = rng.choice((1, 5, 40))
        rows.append((i, f"s{i}", w * 10**7, s * 10**7, (w + side) * 10**7, (s + side) * 10**7, rng.randint(2, 4), rng.randint(4, 6)))
    slices_ = spark.createDataFrame(rows, "slice_pos int, slice string, min_lon_e7 bigint, min_lat_e7 bigint, max_lon_e7 bigint, max_lat_e7 bigint, min_zoom int, max_zoom int")
    tiles_ = spark.createDataFrame([(z, rng.randrange(1 << z), rng.randrange(1 << z)) for z in (2, 3, 4, 5, 6) for _ in range(60)], "z int, x bigint, y bigint")
    boxed = tiles_.distinct().withColumn("b", S.tile_bbox_e7(F.col("z"), F.col("x"), F.col("y"))).select("z", "x", "y", "b.*").collect()
    want = {}
    for t in boxed:
        for i, name, w, s, e, n, low, high in rows:
            lon = t["w"] <= e and t["e"] >= w if symmetric else t["e"] <= e and t["w"] >= w
            if low <= t["z"] <= high and t["s"] <= n and t["n"] >= s and lon:
                want.setdefault((t["z"], t["x"], t["y"]), name)
    got = {(r["z"], r["x"], r["y"]): r["slice"] for r in joins.tile_to_slice(tiles_, slices_, symmetric).collect()}
    assert got == want


def test_empty_geometries(spark):
    texts = [feature("Point", [1, 2]), feature("Polygon", []), feature("Polygon", [[]]), '{"geometry":null}', '{"geometry":{"type":"GeometryCollection","geometries":[]}}', ""]
    assert [r["n"] for r in filters.drop_empty_geometry(lines(spark, *texts)).collect()] == [0]


@pytest.mark.parametrize(("size", "parts"), [(0, 1), (2 * 1024**3, 1), (2 * 1024**3 + 1, 2), (5 * 1024**3, 4), (8 * 1024**3, 4), (8 * 1024**3 + 1, 8)])
def test_partition_count(spark, size, parts):
    assert spark.range(1).select(partitioning.partition_count(F.lit(size).cast("bigint"))).first()[0] == parts


def test_kd_leaves_are_disjoint_and_complete(spark):
    p = inputs.points(spark, "/root/testdata/sf0.001")
    leaves = partitioning.kd_partition(p, 8)
    assert leaves.count() == p.count() and leaves.select("id").distinct().count() == p.count()
    sizes = [r["count"] for r in leaves.groupBy("kd_leaf").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 20


def test_a_hot_point_of_many_leaves(spark, tmp_path):
    # every row in one task: numbers in turn once went to the same half at each level
    here = F.struct(*[F.lit(1.0).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    p = spark.range(60_000).coalesce(1).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), here.alias("bbox"))
    path = str(tmp_path / "hot")
    assert partitioning.write_bounded(p, path, 300_000) >= 8 and partitioning.oversized(spark, path, 300_000).isEmpty()
    assert readers.read_features(spark, path).select("id").distinct().count() == 60_000


def test_leaves_of_many_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partitioning, "GROUP_ROWS", 1_000)
    monkeypatch.setattr(partitioning, "SAMPLE_ROWS", 2_000)
    p = inputs.points(spark, "/root/testdata/sf0.01").select("id", "bbox", "coords")
    # a third of the points at one place, others without a box
    x = F.when(F.col("id") % 3 == 0, 77.0).when(F.col("id") % 100 != 1, F.col("bbox.xmin"))
    y = F.when(F.col("id") % 3 == 0, 12.0).when(F.col("id") % 100 != 1, F.col("bbox.ymin"))
    p = p.withColumn("bbox", F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax")))
    for most in (5_000, 40_000):
        path = str(tmp_path / str(most))
        assert partitioning.write_bounded(p, path, most) > 4 and partitioning.oversized(spark, path, most).isEmpty()
        assert readers.read_features(spark, path).select("id", "bbox", "coords").exceptAll(p).isEmpty()
        assert readers.read_features(spark, path).count() == p.count()


def test_kd_medians_are_exact_beyond_the_accuracy(spark):
    rng = random.Random(3)
    places = [(rng.gauss(77, 4), rng.choice([5.0, 6.0, 7.0, 8.0]) + rng.choice([0, 0, 0, rng.random()])) for _ in range(4001)]
    p = spark.createDataFrame([(i, (x, y, x, y)) for i, (x, y) in enumerate(places)], "id int, bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    leaf = {i: 0 for i in range(len(places))}
    for k in range(3):
        cuts = {v: sorted(places[i][k % 2] for i in leaf if leaf[i] == v) for v in set(leaf.values())}
        leaf = {i: v * 2 + (places[i][k % 2] > cuts[v][(len(cuts[v]) - 1) // 2]) for i, v in leaf.items()}
    for accuracy in (3, 50, 100_000):
        assert {r["id"]: r["kd_leaf"] for r in partitioning.kd_partition(p, 8, accuracy=accuracy).collect()} == leaf


def test_pruned_scan_uses_dynamic_partition_pruning(spark, tmp_path):
    p = inputs.points(spark, "/root/testdata/sf0.001")
    partitioning.write_partitioned(partitioning.kd_partition(p, 8), str(tmp_path / "leaves"))
    stored = readers.read_features(spark, str(tmp_path / "leaves"))
    pruned = joins.prune_partitions(stored, profiles.partition_extents(stored), SQUARE)
    assert "dynamicpruning" in pruned._jdf.queryExecution().toString().lower()
    want = sorted(r["id"] for r in filters.shape_filter(p, SQUARE).collect())
    assert sorted(r["id"] for r in filters.shape_filter(pruned, SQUARE).collect()) == want


def test_bbox_reaches_the_scan(spark, tmp_path):
    p = inputs.points(spark, "/root/testdata/sf0.001")
    sinks.write_geoparquet(p.select("id", "bbox"), str(tmp_path / "p"), sort=["bbox.xmin"])
    plan = filters.bbox_column_filter(readers.read_features(spark, str(tmp_path / "p")), "77,12,78,13")._jdf.queryExecution().toString()
    assert "bbox.xmin" in plan.split("PushedFilters")[1][:400]


def test_spatial_join_is_no_nested_loop(spark):
    j = joins.spatial_join(inputs.points(spark, "/root/testdata/sf0.001"), inputs.polygons(spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in j._jdf.queryExecution().toString() and "Cartesian" not in j._jdf.queryExecution().toString()


def test_tile_rules(spark):
    slices_ = spark.createDataFrame([(0, "a", 0, 0, 450000000, 450000000, 3, 3)], "slice_pos int, slice string, min_lon_e7 bigint, min_lat_e7 bigint, max_lon_e7 bigint, max_lat_e7 bigint, min_zoom int, max_zoom int")
    at = lambda x, y, **k: [r["slice"] for r in joins.tile_to_slice(spark.createDataFrame([(3, x, y)], "z int, x bigint, y bigint"), slices_, **k).collect()]
    assert at(4, 3) == ["a"]  # inside
    assert at(5, 3) == [] and at(5, 3, symmetric=True) == ["a"]  # beyond its east edge, touching
    assert at(4, 2) == ["a"]  # crosses its north edge


def test_wkb_round_trip(spark):
    texts = [feature("Point", [1.5, 2]), feature("LineString", [[1, 2], [3, 4]]), feature("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]]]), feature("MultiPoint", [[1, 2], [3, 4]]), feature("MultiLineString", [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]), feature("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]])]
    df = shapes(spark, *texts).withColumn("back", G.from_wkb(G.to_wkb("coords", "geom_type"))).withColumn("wkt", G.wkt(F.col("coords"), F.col("geom_type")))
    rows = df.orderBy("n").collect()
    assert all(r["back"] == r["coords"] for r in rows)
    assert rows[0]["wkt"] == "POINT (1.5 2)" and rows[2]["wkt"] == "POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))"
    assert rows[5]["wkt"] == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"


def test_fuzzy_words(spark):
    df = spark.createDataFrame([("Districts", "/a"), ("Other-thing", "/b")], "name string, route string")
    names = lambda q: [r["name"] for r in C.fuzzy_search(df, q).collect()]
    assert names("distrcts") == ["Districts"] and names("xyzq") == [] and names("thng") == ["Other-thing"]


def test_display(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(S.readable_size(F.lit(n).cast("bigint"))) for n in (0, 1024, 1536)] == ["0.00 KB", "1.0 KB", "1.5 KB"]
    assert one(S.md_to_html(F.lit("[a](http://x) and http://y then <a href=\"http://z\">http://z</a>"))) == '<a href="http://x">a</a> and <a href="http://y">http://y</a> then <a href="http://z">http://z</a>'
    assert [one(S.part_label(F.lit(n))) for n in ("data.0.parquet", "rg_15", "data.parquet")] == ["0", "15", None]


def test_stream_equals_batch(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "a.geojsonl").write_text(feature("Point", [77.5, 12.5], name="in", k=1) + "\n{bad\n" + feature("Point", [80, 15], name="out"))
    (landed / "b.geojsonl").write_text(feature("LineString", [[76, 12.5], [79, 12.5]], name="line"))
    out = str(tmp_path / "out")
    counters = stream.Counters()
    query = stream.stream_filter(spark, str(landed), out, SQUARE, {"name": "str", "k": "int"}, str(tmp_path / "check"), counters=counters)
    query.awaitTermination()
    batch = stream.filter_lines(spark.read.text(str(landed)).withColumnRenamed("value", "line"), SQUARE, {"name": "str", "k": "int"}).select("properties.*")
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("name", "k").collect())
    assert got == sorted(tuple(r) for r in batch.collect()) == [("in", 1), ("line", None)]
    seen = counters.of(query)
    spark.streams.removeListener(counters)
    assert seen["unparsed"] == 1 and seen["count"] == 4


def test_counters_of_more_batches_than_spark_remembers(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    for i in range(9):
        (landed / f"{i}.geojsonl").write_text(feature("Point", [77.5, 12.5], k=i) + "\n{bad\n")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    counters = stream.Counters()
    try:
        query = stream.stream_filter(spark, str(landed), str(tmp_path / "out"), SQUARE, {"k": "int"}, str(tmp_path / "check"), files=1, counters=counters)
        query.awaitTermination()
        seen = counters.of(query)
        assert len(query.recentProgress) < 9 and (seen["count"], seen["unparsed"]) == (18, 9)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(counters)


def test_running_total_without_a_global_window(spark):
    df = spark.range(1, 500).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["before"] for r in partitioning.running_total(df, ["id"], "v").collect()}
    total, want = 0, {}
    for i in range(1, 500):
        want[i] = total
        total += i % 7
    assert got == want


def _boxes(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.uniform(-179, 170), rng.uniform(-80, 70)
        w = rng.choice([0, 0.001, 1, 9, 60])
        rows.append((i, x, y, min(180.0, x + w), min(84.0, y + w / 2)))
    df = spark.createDataFrame([*rows, (n, None, None, None, None)], "id int, w double, s double, e double, n double")
    return df.select("id", F.when(F.col("w").isNotNull(), F.struct(F.col("w").alias("xmin"), F.col("s").alias("ymin"), F.col("e").alias("xmax"), F.col("n").alias("ymax"))).alias("bbox"))


def test_tiles_covered_whole_stay_whole(spark):
    world = spark.range(1).select("id", F.struct(*[F.lit(v).alias(c) for v, c in ((-180.0, "xmin"), (-85.06, "ymin"), (180.0, "xmax"), (85.06, "ymax"))]).alias("bbox"))
    assert [tuple(r["tile"]) for r in partitioning.tile_cover(world, 14).collect()] == [(0, 0, 0)]
    india = world.withColumn("bbox", F.struct(*[F.lit(v).alias(c) for v, c in ((68.0, "xmin"), (8.0, "ymin"), (97.0, "xmax"), (37.0, "ymax"))]))
    n = partitioning.tile_cover(india, 12).count()
    assert n < 3000 < 100_000 < 29 / 360 * 4096 * 340  # its outline, not its area
    boxes = _boxes(spark, 60, 3)
    plain = sorted(tuple(r) for r in partitioning.tile_assign(boxes.where("bbox is not null"), [6]).select("id", "x", "y").collect())
    got = [(r["id"], r["tile"]["x"] * k + i, r["tile"]["y"] * k + j) for r in partitioning.tile_cover(boxes, 6).collect() for k in [1 << 6 - r["tile"]["z"]] for i in range(k) for j in range(k)]
    assert sorted(got) == plain


def test_pyramid_against_counting_each_zoom(spark):
    boxes = _boxes(spark, 80, 4)
    zooms = list(range(0, 7))
    got = sorted(map(tuple, partitioning.pyramid_counts(partitioning.tile_pyramid(boxes, 6), zooms).collect()))
    assert got == sorted(map(tuple, partitioning.tile_counts(partitioning.tile_assign(boxes.where("bbox is not null"), zooms)).collect()))
    assert partitioning.tile_pyramid(boxes.limit(0), 3).count() == 0


@pytest.mark.parametrize("n", [1, 7, 400])
def test_thinning_orders_what_may_stay(spark, n):
    rows = [(i, 3, 1, 1) for i in range(3000)] + [(i, 3, 2, i % 2) for i in range(9)] + [(5, 4, 0, 0)] * 1200  # one id alone: all hashes equal
    tiles = spark.createDataFrame(rows, "id int, z int, x int, y int")
    got = {}
    for r in partitioning.thin_tiles(tiles, n).collect():
        got.setdefault((r["z"], r["x"], r["y"]), []).append(r["id"])
    want = {}
    for i, *at in rows:
        want.setdefault(tuple(at), []).append(i)
    import zlib

    for at, ids in want.items():
        assert sorted(got[at]) == sorted(sorted(ids, key=lambda i: (zlib.crc32(str(i).encode()), i))[:n])


def test_the_densest_features_are_dropped_until_a_tile_fits(spark):
    near = [(i, 77.0 + i * 1e-7, 12.0) for i in range(900)]
    far = [(1000 + i, 60.0 + i % 10 * 3, 1.0 + i // 10 * 3) for i in range(60)]
    df = spark.createDataFrame(near + far, "id int, lon double, lat double").withColumn("bbox", F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax")))
    spaced = partitioning.spacing(df.repartition(3)).withColumn("bytes", F.lit(10))
    kept = partitioning.fit_tiles(partitioning.tile_assign(spaced, [1, 12]), 1000).select("z", "x", "y", "id").collect()
    low = [r["id"] for r in kept if r["z"] == 1]
    assert 60 <= len(low) <= 100 and {i for i in low if i >= 1000} == {1000 + i for i in range(60)}
    by_tile = {}
    for r in kept:
        by_tile.setdefault((r["z"], r["x"], r["y"]), []).append(r["id"])
    assert all(0 < len(ids) <= 100 for ids in by_tile.values())
    gaps = {r["id"]: r["gap"] for r in partitioning.spacing(df.repartition(1)).collect()}
    assert gaps == {r["id"]: r["gap"] for r in spaced.collect()} and list(gaps.values()).count(None) == 1


def test_order_over_files_of_unlike_size(spark, tmp_path):
    (tmp_path / "a.json").write_text(feature("Point", [1, 2], Name=1, my_geom="x") + "\n")
    (tmp_path / "b.json").write_text("\n".join(feature("Point", [1, 2], name=i, geom_x="y", later=1.5) for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = readers.read_geojsonl(spark, str(tmp_path), order="at")
        assert lines.rdd.getNumPartitions() > 3
        types, renames = schema.schema_of(lines, order="at")
        assert list(types) == ["Name", "my_geom", "name_2", "geom_x", "later"] and renames == {"name": "name_2"}
        assert [tuple(r) for r in filters.geometry_name_renames(lines, order="at").collect()] == [("my_geom", "geom_renamed_1"), ("geom_x", "geom_renamed_2")]
        assert filters.rename_geom_props(lines, order="at").columns == lines.columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_counters_of_a_query_that_does_not_end_raise():
    class Query:
        runId = "r"

    with pytest.raises(TimeoutError):
        stream.Counters().of(Query(), seconds=0.01)
