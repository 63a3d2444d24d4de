"""Files along the curve: a box meets few row groups in both axes."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from geoloom.functions import curve as C
from geoloom.functions import geometry as G
from geoloom.sources import sinks


def _met(path, box):
    """Row groups whose boxes meet the box, of how many, as a reader sees them."""
    w, s, e, n = box
    met = groups = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for i in range(meta.num_row_groups):
            columns = [meta.row_group(i).column(c) for c in range(meta.num_columns)]
            stats = {c.path_in_schema: c.statistics for c in columns}
            met += stats["bbox.xmin"].min <= e and stats["bbox.xmax"].max >= w and stats["bbox.ymin"].min <= n and stats["bbox.ymax"].max >= s
            groups += 1
    return met, groups


def test_a_box_meets_few_row_groups(spark, tmp_path):
    df = spark.range(40_000).select("id", (60 + F.rand(1) * 40).alias("x"), F.rand(2).alias("v")).withColumn("y", F.rand(3) * 40)
    df = df.withColumn("bbox", G.bbox(G.point_coords(F.col("x"), F.col("y")))).select("id", "bbox")
    curve, strips = str(tmp_path / "curve"), str(tmp_path / "strips")
    sinks.write_geoparquet(df, curve, level=3, rows=400)
    sinks.write_geoparquet(df, strips, level=3, rows=400, sort=["bbox.xmin"])
    assert spark.read.parquet(curve).columns == ["id", "bbox"] and spark.read.parquet(curve).distinct().count() == 40_000
    for box in ((70, 10, 74, 14), (60, 20, 100, 20.4), (80, 0, 80.4, 40)):  # a square, a strip along either axis
        met, groups = _met(curve, box)
        assert groups >= 100 and met <= groups / 4
    assert _met(curve, (70, 10, 74, 14))[0] * 2 < _met(strips, (70, 10, 74, 14))[0]


def test_one_place_and_no_rows(spark, tmp_path):
    here = spark.range(3_000).withColumn("bbox", G.bbox(G.point_coords(F.lit(77.0), F.lit(12.0))))
    sinks.write_geoparquet(here, str(tmp_path / "here"), level=3)
    assert spark.read.parquet(str(tmp_path / "here")).count() == 3_000
    sinks.write_geoparquet(here.limit(0), str(tmp_path / "none"), level=3)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_places_of_a_batch_are_those_of_the_column(spark):
    places = [(-180.0, -90.0), (180.0, 90.0), (77.5, 12.5), (-200.0, 95.0), (0.0, 0.0), (12.3, -45.6)]
    df = spark.createDataFrame([((x, y, x, y),) for x, y in places], "bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    x, y = np.array(places).T
    assert C.curve_places(x, y).tolist() == [r[0] for r in df.select(C.curve(F.col("bbox"))).collect()]
    assert C.curve_places(np.array([np.nan]), np.array([1.0])).tolist() == [-1]
