"""Reconciling asset listings with the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import base_name, release_parts

#: Classes of assets: name, pattern of what follows the base name. The first that fits counts.
CLASSES = (
    ("archive", r"(?i)\.geojsonl\.7z(\.\d{3})?$"),
    ("meta", r"\.parquet\.meta\.json$"),
    ("analysis", r"\.analysis\.json$"),
    ("part", r"\.\d+\.parquet$"),
    ("parquet", r"\.parquet$"),
    ("tiles_part", r"-part\d+\.pmtiles$"),
    ("tiles", r"\.pmtiles$"),
    ("mosaic", r"\.mosaic\.json$"),
)


def _first(c: Column, value) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CLASSES):
        out = F.when(c.rlike(pattern), value(name, pattern)).otherwise(out)
    return out


def classified(assets: DataFrame) -> DataFrame:
    """``class`` and ``base`` of each asset; null for others."""
    a = F.col("asset")
    return assets.withColumn("class", _first(a, lambda n, _: F.lit(n))).withColumn("base", _first(a, lambda _, p: F.regexp_replace(a, p, "")))


def catalog_keys(cat: DataFrame) -> DataFrame:
    """Catalog rows with the repo, tag and base name of their archive."""
    parts = release_parts(F.col("url"))
    return cat.withColumn("_r", parts).select("*", F.col("_r.repo").alias("repo"), F.col("_r.tag").alias("tag"), base_name(F.col("_r.filename")).alias("base")).drop("_r")


def match_assets(cat: DataFrame, assets: DataFrame) -> DataFrame:
    """Number of assets of each class that belong to each catalog row."""
    counts = classified(assets).where("class is not null").groupBy("repo", "tag", "base").pivot("class", [n for n, _ in CLASSES]).count()
    return catalog_keys(cat).join(counts, ["repo", "tag", "base"], "left").fillna(0, [n for n, _ in CLASSES])


def skip_done(todo: DataFrame, done: DataFrame, keys: list[str], retry_errors: bool = True) -> DataFrame:
    """What isn't done yet; failed work counts as not done."""
    finished = done.where("error is null") if retry_errors else done
    return todo.join(finished.select(keys).distinct(), keys, "left_anti")


def apply_ids(cat: DataFrame, picks: DataFrame) -> DataFrame:
    """Catalog rows with the picked id written back."""
    p = picks.select("route", F.col("picked").alias("_picked"))
    return cat.join(p, "route", "left").withColumn("promoteid", F.coalesce("_picked", "promoteid")).drop("_picked")


def partitioned_bases(assets: DataFrame) -> DataFrame:
    """Bases with more than one numbered Parquet asset."""
    return classified(assets).where("class = 'part'").groupBy("repo", "tag", "base").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")


def mark_partitioned(cat: DataFrame, assets: DataFrame) -> DataFrame:
    """Mark rows that have partitions; rows already marked, raster rows and other handlers stay as they are."""
    keyed = catalog_keys(cat).join(partitioned_bases(assets), ["repo", "tag", "base"], "left")
    touch = F.col("parts").isNotNull() & ~F.col("type").eqNullSafe("raster") & F.col("handlertype").isin("pmtiles", "mosaic")
    return keyed.withColumn("partitioned_parquet", F.coalesce("partitioned_parquet", F.lit(False)) | F.coalesce(touch, F.lit(False))).select(cat.columns)


def upsert_routes(cat: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace the rows with their route; other rows stay."""
    return cat.join(entries.select("route"), "route", "left_anti").unionByName(entries, allowMissingColumns=True)


def with_promoteid(entries: DataFrame, analysis: DataFrame) -> DataFrame:
    """Entries with a ``promoteid``: the explicit one, else the field that the analysis of their route picked, else none."""
    picked = analysis.groupBy("route").agg(F.max(F.nullif("field", F.lit(""))).alias("_field"))
    explicit = F.nullif("promoteid", F.lit(""))
    return entries.join(picked, "route", "left").withColumn("promoteid", F.coalesce(explicit, "_field")).drop("_field")


def add_assets(listing: DataFrame, new: DataFrame) -> DataFrame:
    return listing.union(new).distinct().orderBy("asset")


def change_assets(listing: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """The listing without what is removed and with what is added; blanks dropped."""
    return listing.join(remove, listing.columns, "left_anti").union(add).where("trim(asset) <> ''").distinct().orderBy("asset")


def concat(dfs: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
