"""Column profiles, identifiers, extents and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import id_score


PROFILE_SCHEMA = "dataset string, ordinal int, column string, distinct_values long, null_count long, total long, is_unique boolean"


def _value_key(name: str, data_type: T.DataType, ordinal: int) -> Column:
    """A column's value as numbers of a set width: the group that it falls in (``high``, ``low``) and its bit there.

    Whole numbers, booleans and dates share a group of 64 neighbouring values, a bit for each. Any other value has a group of
    its own, named by two hashes of 64 bits. A null has neither.
    """
    value = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)):
        number = (F.unix_date(value) if isinstance(data_type, T.DateType) else value).cast("long")
        high, low = F.shiftright(number, 6), F.lit(0).cast("long")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    else:
        plain = (T.StringType, T.BinaryType, T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.TimestampNTZType)
        hashed = value if isinstance(data_type, plain) else value.cast("string")
        high, low = F.when(value.isNotNull(), F.xxhash64(hashed)), F.xxhash64(F.lit(ordinal), hashed)
        bit = F.lit(1).cast("long")
    return F.struct(F.lit(ordinal).alias("ordinal"), high.alias("high"), F.when(value.isNotNull(), low).alias("low"), F.when(value.isNotNull(), bit).alias("bit"))


def profile_columns(df: DataFrame, dataset: str, exclude: tuple[str, ...] = ("geometry",)) -> DataFrame:
    """Distinct values, nulls and uniqueness of every column, in one pass over the table.

    Values are combined within each task before they are shuffled: whole numbers and dates as bitmaps of 64 neighbours, which
    never take more rows than the values themselves and up to 64 times fewer, others by 128 bits of hash instead of their text.
    So the shuffle holds the distinct values of each task, in rows of a set width however long the texts are, and a frequent
    value is a row a task. Equal numbers count once (0.0 and -0.0, all NaN); nested values are compared as text. An empty table
    has no rows here.
    """
    columns = [f for f in df.schema.fields if f.name not in exclude]
    if not columns:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    keys = df.select(*[_value_key(f.name, f.dataType, i).alias(f"_{i}") for i, f in enumerate(columns)])
    values = keys.unpivot([], list(keys.columns), "_name", "_key").select("_key.*")
    groups = values.groupBy("ordinal", "high", "low").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    counted = groups.groupBy("ordinal").agg(
        F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0)).alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("bits").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.sum("n").alias("total"),
    )
    names = F.array(*[F.lit(f.name) for f in columns])
    return counted.select(
        F.lit(dataset).alias("dataset"), "ordinal", F.element_at(names, F.col("ordinal") + 1).alias("column"), "distinct_values", "null_count", "total",
        ((F.col("distinct_values") == F.col("total")) & (F.col("null_count") == 0)).alias("is_unique"),
    )


def pick_ids(profiles: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The best identifier of each dataset: unique columns first, then nearly unique ones, else the best of the rest."""
    scored = profiles.withColumn("score", id_score(F.col("column"))).where("score is not null and total > 0")
    ratio = F.col("distinct_values") / F.col("total")
    tier = F.when(F.col("is_unique"), 1).when(ratio >= threshold, 2).otherwise(3)
    scored = scored.withColumn("ratio", ratio).withColumn("tier", tier)
    order = Window.partitionBy("dataset").orderBy(
        "tier",
        F.desc(F.when(F.col("tier") == 1, F.col("score").cast("double")).otherwise(F.col("ratio"))),
        F.when(F.col("tier") == 1, F.length("column")).when(F.col("tier") == 2, -F.col("score")).otherwise(F.col("null_count")),
        F.when(F.col("tier") == 3, -F.col("score")).otherwise(F.lit(0)),
        "ordinal",
    )
    best = scored.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select("dataset", F.col("column").alias("best"), "tier", "ratio", "score", F.when(F.col("tier") < 3, F.col("column")).alias("picked"))


def order_profile(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("distinct_values"), "ordinal")


def run_summary(results: DataFrame) -> DataFrame:
    """Number of datasets by outcome; a dataset with an error counts as one."""
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("tier") == 1, "unique").when(F.col("tier") == 2, "candidate").otherwise("none")
    return results.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def process_summary(cat: DataFrame) -> DataFrame:
    """Number of catalog rows by outcome: raster rows and rows of other handlers are skipped, the rest has an ``error`` or is processed."""
    skipped = F.coalesce(F.col("type") == "raster", F.lit(False)) | ~F.coalesce(F.col("handlertype").isin("pmtiles", "mosaic"), F.lit(False))
    outcome = F.when(skipped, "skipped").when(F.col("error").isNotNull(), "error").otherwise("processed")
    return cat.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def bounds_of(df: DataFrame, by: list[str] | None = None, box: str = "bbox") -> DataFrame:
    """Least box around all boxes of a group."""
    b = F.col(box)
    parts = [F.min(b["xmin"]).alias("minx"), F.min(b["ymin"]).alias("miny"), F.max(b["xmax"]).alias("maxx"), F.max(b["ymax"]).alias("maxy")]
    return df.groupBy(*(by or [])).agg(*parts)


def partition_extents(df: DataFrame, by: str = "kd_leaf") -> DataFrame:
    """Extent of each partition."""
    return bounds_of(df, [by])


def schema_union(schemas: DataFrame) -> DataFrame:
    """Columns of all files; the first file that has a column gives its type and place."""
    return schemas.groupBy("column").agg(F.min_by("type", "file_pos").alias("type"), F.min(F.struct("file_pos", "position")).alias("first"))


def geometry_type_union(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All geometry types of a group, sorted; ``types`` is a list in each row."""
    return df.groupBy(*(by or [])).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))
