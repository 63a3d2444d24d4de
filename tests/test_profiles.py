"""Column profiles against a plain count of values."""

import datetime as dt
import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators.profiles import pick_ids, profile_columns

SCHEMA = (
    "big long, small short, flag boolean, day date, at timestamp, ratio double, thin float, price decimal(20,2), name string, raw binary, "
    "`a.b` string, `odd``name` int, ordinal int, bit long, high string, tags array<string>, box struct<x: double, y: int>, props map<string, int>, geometry string"
)


def _plain(values):
    """Distinct values, nulls and rows, counted in Python; equal numbers are one value and so are all NaN."""
    def key(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        if isinstance(v, dict):
            return tuple(v.items())
        return tuple(key(x) for x in v) if isinstance(v, (list, tuple)) else v

    kept = [key(v) for v in values if v is not None]
    return len(set(kept)), len(values) - len(kept), len(values)


def _rows(n, seed):
    rng = random.Random(seed)
    some = lambda make: None if rng.random() < 0.1 else make()
    out = []
    for _ in range(n):
        out.append((
            some(lambda: rng.choice([-(2**63), 2**63 - 1, -1, 0, 63, 64, -64, -65, rng.randrange(-500, 500)])),
            some(lambda: rng.randrange(-300, 300)), some(lambda: rng.random() < 0.5),
            some(lambda: dt.date(1960, 1, 1) + dt.timedelta(rng.randrange(9000))), some(lambda: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randrange(90))),
            some(lambda: rng.choice([0.0, -0.0, math.nan, math.inf, rng.random()])), some(lambda: rng.choice([0.0, -0.0, math.nan, 0.5])),
            some(lambda: decimal.Decimal(rng.randrange(10**6)) / 100), some(lambda: rng.choice(["", " ", "a", "A", "é" * rng.randrange(50)])),
            some(lambda: bytes([rng.randrange(4)] * rng.randrange(3))), some(lambda: str(rng.randrange(5))), some(lambda: rng.randrange(5)),
            some(lambda: rng.randrange(9)), some(lambda: rng.randrange(70)), None,
            some(lambda: [some(lambda: "t")] * rng.randrange(3)), some(lambda: (rng.choice([0.5, 1.5]), rng.randrange(3))), some(lambda: {"k": rng.randrange(3)}), "POINT EMPTY",
        ))
    return out


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_equal_to_plain_counts(spark, n):
    rows = _rows(n, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["column"]: r for r in profile_columns(df, "d").collect()}
    assert list(sorted(got, key=lambda c: got[c]["ordinal"])) == [c for c in df.columns if c != "geometry"]
    for i, name in enumerate(df.columns[:-1]):
        distinct, nulls, total = _plain([r[i] for r in rows])
        assert (got[name]["distinct_values"], got[name]["null_count"], got[name]["total"]) == (distinct, nulls, total), name
        assert got[name]["is_unique"] == (distinct == total and nulls == 0)


def test_empty_tables_and_tables_of_geometry_only(spark):
    assert profile_columns(spark.createDataFrame([], SCHEMA), "d").collect() == []
    only = profile_columns(spark.createDataFrame([("POINT EMPTY",)], "geometry string"), "d")
    assert only.collect() == [] and pick_ids(only).collect() == []


def test_neighbouring_numbers_are_combined_before_the_shuffle(spark):
    """Dense numbers and long texts with few values cross the shuffle as a row for 64 numbers and a row for a text."""
    df = spark.range(0, 64 * 1000, numPartitions=4).withColumn("text", F.repeat(F.lit("long text "), 1000))
    profile = profile_columns(df, "d")
    counted = {r["column"]: (r["distinct_values"], r["is_unique"]) for r in profile.collect()}
    assert counted == {"id": (64000, True), "text": (1, False)}
    plan = profile._jdf.queryExecution().executedPlan()
    written = [int(v) for v in _metric(plan, "shuffleRecordsWritten")]
    assert max(written) == 1000 + 4


def _metric(plan, name):
    """The values of a metric over all nodes of an executed plan."""
    node = plan.getClass().getSimpleName()
    if node == "AdaptiveSparkPlanExec":
        return _metric(plan.executedPlan(), name)
    if node.endswith("QueryStageExec"):
        return _metric(plan.plan(), name)
    metrics = plan.metrics()
    here = [metrics.apply(name).value()] if metrics.contains(name) else []
    children = plan.children()
    return here + [v for i in range(children.size()) for v in _metric(children.apply(i), name)]
