"""Property schema inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_class(kind: Column, raw: Column) -> Column:
    """Type class of a property from its variant kind; the raw text tells whole numbers beyond 64 bits from decimals."""
    return (
        F.when(kind.isNull() | (kind == "VOID"), "NoneType")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "STRING", "str")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
        .when(kind == "BIGINT", "int")
        .when(kind.rlike(r"^DECIMAL\((?:19|[23]\d),0\)$") & raw.rlike("^-?[0-9]+$"), "int")
        .otherwise("float")
    )


def merge_classes(types: Column) -> Column:
    """One type for a key from the set of its classes."""
    numbers = F.when(F.array_contains(types, "int") & F.array_contains(types, "float"), F.array_remove(types, "int")).otherwise(types)
    plain = F.when(F.array_contains(numbers, "NoneType") & (F.size(numbers) == 2), F.array_remove(numbers, "NoneType")).otherwise(numbers)
    only = F.get(plain, 0)
    return F.when(F.size(plain) > 1, "str").when(only == "NoneType", "str").otherwise(only)


def infer_properties(df: DataFrame, line: str = "line", order: str | None = None) -> DataFrame:
    """``key``, ``type`` and first appearance of the properties of feature lines.

    ``order`` is a column with the lines' order, such as ``read_geojsonl`` gives
    for several files; without it that of an unshuffled scan is taken, which is
    right for one file. Lines that aren't JSON are skipped.
    """
    number = F.col(order) if order else F.monotonically_increasing_id()
    # a line is parsed once; its text is kept for the rare numbers that the variant can't tell apart
    properties = F.map_entries(F.from_json(line, "struct<properties: map<string, variant>>")["properties"])
    each = df.select(number.alias("_n"), F.col(line).alias("_line"), F.posexplode(properties).alias("_k", "_e"))
    each = each.select("_n", "_k", "_line", F.col("_e.key").alias("key"), F.schema_of_variant("_e.value").alias("_kind"))
    raw = F.element_at(F.from_json(F.get_json_object("_line", "$.properties"), "map<string, string>"), F.col("key"))
    each = each.select("_n", "_k", "key", value_class(F.col("_kind"), raw).alias("class"))
    found = each.groupBy("key").agg(F.array_sort(F.collect_set("class")).alias("classes"), F.min(F.struct("_n", "_k")).alias("first"))
    return found.select("key", merge_classes(F.col("classes")).alias("type"), "classes", "first")


def geometry_types(df: DataFrame, line: str = "line") -> DataFrame:
    """The geometry types of feature lines, as one sorted list."""
    kind = F.get_json_object(line, "$.geometry.type")
    return df.select(kind.alias("k")).where("k is not null").agg(F.array_sort(F.collect_set("k")).alias("geometry_types"))


def case_renames(keys: list[str]) -> dict[str, str]:
    """New names of keys that differ from an earlier one in case only."""
    taken: set[str] = set()
    renames = {}
    for key in keys:  # one entry a column
        name, n = key, 2
        while name.lower() in taken:
            name, n = f"{key}_{n}", n + 1
        taken.add(name.lower())
        if name != key:
            renames[key] = name
    return renames


def schema_of(df: DataFrame, line: str = "line", order: str | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """Properties with their types, and the renames that make names unique."""
    rows = infer_properties(df, line, order).orderBy("first").collect()
    renames = case_renames([r["key"] for r in rows])
    return {renames.get(r["key"], r["key"]): r["type"] for r in rows}, renames
