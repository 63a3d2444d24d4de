"""Catalog search and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edit_distance_limit


def vector_sources(cat: DataFrame) -> DataFrame:
    """Everything that isn't raster; a missing type counts as vector."""
    return cat.where(~F.col("type").eqNullSafe("raster"))


def raster_sources(cat: DataFrame) -> DataFrame:
    return cat.where(F.col("type").eqNullSafe("raster"))


def category_any(cat: DataFrame, names: list[str]) -> DataFrame:
    """Rows in any of the categories, case folded."""
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    return cat.where(F.arrays_overlap(F.transform("categories", F.lower), wanted))


def category_all(cat: DataFrame, names: list[str]) -> DataFrame:
    """Rows in all of the categories, as they are written."""
    return cat.where(F.size(F.array_except(F.array(*map(F.lit, names)), "categories")) == 0)


def fuzzy_match(text: Column, query: str, max_distance: int = 2) -> Column:
    """The folded text contains the query, or has a word that is few edits away."""
    q, folded = query.lower(), F.lower(text)
    words = F.filter(F.split(F.translate(folded, "-_", "  "), r"\s+"), lambda w: w != "")
    near = F.exists(words, lambda w: F.levenshtein(w, F.lit(q)) <= edit_distance_limit(w, max_distance))
    return folded.contains(q) | near


def fuzzy_search(cat: DataFrame, q: str, max_distance: int = 2) -> DataFrame:
    """Rows whose name or route matches the query, misspelt or not."""
    return cat.where(fuzzy_match(F.col("name"), q, max_distance) | fuzzy_match(F.col("route"), q, max_distance))


def text_search(cat: DataFrame, q: str, fields: tuple[str, ...] = ("name", "route", "description", "notes")) -> DataFrame:
    """Rows with the folded query in a field or in any category."""
    q = q.lower()
    tests = [F.coalesce(F.lower(f).contains(q), F.lit(False)) for f in fields]
    tests.append(F.coalesce(F.exists("categories", lambda c: F.lower(c).contains(q)), F.lit(False)))
    return cat.where(reduce(Column.__or__, tests))


def with_source_number(cat: DataFrame) -> DataFrame:
    """Vector sources with their 1-based number in catalog order; filters later keep it.

    A catalog is one small file, so one ordered window is enough.
    """
    return vector_sources(cat).withColumn("number", F.row_number().over(Window.orderBy("pos")))


def resolve_source(cat: DataFrame, text: str) -> DataFrame:
    """The source that a number, a route (with ``/``) or a name stands for; a number never stands for a name."""
    rows = with_source_number(cat)
    if text.isdigit():
        found = F.col("number") == int(text)
    elif text.startswith("/"):
        found = F.col("route") == text
    else:
        found = F.col("name") == text
    return rows.where(found).orderBy("pos").limit(1)


def url_allowed(df: DataFrame, prefixes: list[str], url: str = "url") -> DataFrame:
    """Rows whose URL begins with a listed prefix."""
    return df.where(reduce(Column.__or__, [F.col(url).startswith(p) for p in prefixes], F.lit(False)))


def lint_routes(cat: DataFrame) -> DataFrame:
    """Rows whose route doesn't begin with a slash."""
    return cat.where(~F.col("route").startswith("/"))


def category_counts(cat: DataFrame, fold_case: bool = True) -> DataFrame:
    """Sources of each category; a source in several counts for each."""
    each = cat.select(F.explode("categories").alias("category"))
    return each.groupBy((F.lower("category") if fold_case else F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def order_categories(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), "category")


def order_catalog(cat: DataFrame, locale: str | None = None) -> DataFrame:
    """By name; with a locale by its collation (``UNICODE`` for the root locale)."""
    return cat.orderBy(F.collate("name", locale) if locale else "name", "route")


def tilejson(cat: DataFrame, headers: DataFrame) -> DataFrame:
    """TileJSON of each catalog row, from its archive's header (degrees times 1e7)."""
    mime = F.create_map(*[F.lit(x) for kv in {1: "application/x-protobuf", 2: "image/png", 3: "image/jpeg", 4: "image/webp", 5: "image/avif"}.items() for x in kv])
    deg = lambda c: F.col(c) / 1e7
    rows = cat.join(headers, "route")
    source = F.concat(F.lit("Source: "), F.col("name"))
    return rows.select(
        "route",
        F.to_json(F.struct(
            F.lit("3.0.0").alias("tilejson"), "name",
            F.concat(F.lit("/"), F.ltrim("route", F.lit("/")), F.lit("/{z}/{x}/{y}."), "tilesuffix").alias("tiles"),
            F.array(*map(deg, ("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7"))).alias("bounds"),
            F.array((deg("min_lon_e7") + deg("max_lon_e7")) / 2, (deg("min_lat_e7") + deg("max_lat_e7")) / 2).alias("center"),
            F.col("min_zoom").alias("minzoom"), F.col("max_zoom").alias("maxzoom"),
            F.when(F.col("license").isNull(), source).otherwise(F.concat(source, F.lit(" | License: "), F.col("license"))).alias("attribution"),
        )).alias("tilejson"),
        F.element_at(mime, F.col("tile_type")).alias("mime"),
    )
