"""Item search and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _link(rel: str, href: Column, kind: str = "application/json") -> Column:
    return F.struct(F.lit(rel).alias("rel"), F.lit(kind).alias("type"), href.alias("href"))


def _collection_url(collection: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/collections/"), collection)


#: Property of an item document and the column it comes from.
PROPERTIES = (("datetime", "datetime"), ("proj:epsg", "proj_epsg"), ("proj:shape", "proj_shape"), ("proj:transform", "proj_transform"))


def stac_documents(items: DataFrame, base: str = "/stac") -> DataFrame:
    """Items as feature documents with assets, projection and links; null properties and empty extension lists are left out."""
    has = lambda c: c in items.columns
    collection = _collection_url(F.col("collection"), base)
    properties = [F.col(c).alias(n) for n, c in PROPERTIES if has(c)]
    assets = F.coalesce(F.parse_json(F.to_json("assets")), F.parse_json(F.lit("{}"))) if has("assets") else F.parse_json(F.lit("{}"))
    extensions = [F.when(F.size("stac_extensions") > 0, F.col("stac_extensions")).alias("stac_extensions")] if has("stac_extensions") else []
    geo = "application/geo+json"
    links = F.array(_link("self", F.concat(collection, F.lit("/items/"), "id"), geo), _link("root", F.lit(base)), _link("collection", collection), _link("parent", collection))
    return items.select(
        "collection", "id",
        F.to_json(F.struct(
            F.lit("Feature").alias("type"), "stac_version", *extensions, "id", "collection", "bbox",
            F.struct(F.lit("Polygon").alias("type"), F.col("ring").alias("coordinates")).alias("geometry"),
            (F.struct(*properties) if properties else F.parse_json(F.lit("{}"))).alias("properties"),
            assets.alias("assets"), links.alias("links"),
        ), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}).alias("document"),
    )


def collection_documents(collections: DataFrame, items: DataFrame, base: str = "/stac") -> DataFrame:
    """Collections with the extent that their items have (the world where there are none) and an open interval."""
    box = items.groupBy(F.col("collection").alias("id")).agg(*[f(F.get("bbox", i)).alias(n) for i, (n, f) in enumerate((("w", F.min), ("s", F.min), ("e", F.max), ("n", F.max)))])
    extent = F.struct(
        F.struct(F.array(F.when(F.col("known"), F.array("w", "s", "e", "n")).otherwise(F.array(*map(F.lit, (-180.0, -90.0, 180.0, 90.0))))).alias("bbox")).alias("spatial"),
        F.struct(F.array(F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))).alias("interval")).alias("temporal"),
    )
    url = _collection_url(F.col("id"), base)
    links = F.array(_link("self", url), _link("root", F.lit(base)), _link("items", F.concat(url, F.lit("/items")), "application/geo+json"))
    return collections.join(box.withColumn("known", F.lit(True)), "id", "left").select(
        "id",
        F.to_json(F.struct(
            F.lit("1.0.0").alias("stac_version"), F.lit("Collection").alias("type"), "id", "title", F.concat(F.lit("Collection "), "id").alias("description"),
            F.lit("various").alias("license"), extent.alias("extent"), links.alias("links"),
        )).alias("document"),
    )


#: What an item service conforms to; fixed values.
CONFORMS_TO = (
    "https://api.stacspec.org/v1.0.0/core",
    "https://api.stacspec.org/v1.0.0/collections",
    "https://api.stacspec.org/v1.0.0/item-search",
    "http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/core",
    "http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/geojson",
)


def catalog_document(collections: DataFrame, id_: str = "stac-api", title: str = "STAC API", description: str = "", base: str = "/stac") -> DataFrame:
    """The landing document, one row: a child link for each collection, in the order of ``pos``."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda c: _link("child", _collection_url(c["id"], base)))
    own = [("self", base), ("root", base), ("data", f"{base}/collections"), ("conformance", f"{base}/conformance"), ("search", f"{base}/search")]
    links = F.concat(F.array(*[_link(rel, F.lit(href)) for rel, href in own]), children)
    return collections.agg(
        F.to_json(F.struct(
            F.lit("1.0.0").alias("stac_version"), F.lit("Catalog").alias("type"), F.lit(id_).alias("id"), F.lit(title).alias("title"), F.lit(description).alias("description"),
            F.array(*map(F.lit, CONFORMS_TO)).alias("conformsTo"), links.alias("links"),
        )).alias("document")
    )


def stac_item(items: DataFrame, collection: str, id_: str) -> DataFrame:
    """The item with the id, wherever in the collection it stands."""
    return items.where((F.col("collection") == collection) & (F.col("id") == id_))


def stac_bbox(items: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Items whose box overlaps, touching included."""
    w, s, e, n = map(float, bbox)
    b = F.col("bbox")
    return items.where((F.get(b, 0) <= e) & (F.get(b, 2) >= w) & (F.get(b, 1) <= n) & (F.get(b, 3) >= s))


def page(df: DataFrame, pos: str | list[str], limit: int = 10, offset: int = 0) -> DataFrame:
    """One page of rows in the order of ``pos``."""
    keys = [pos] if isinstance(pos, str) else pos
    return df.orderBy(*keys).offset(offset).limit(limit)


def stac_search(items: DataFrame, collections: list[str] | None = None, bbox=None, limit: int = 10) -> DataFrame:
    """Items of the listed collections (unknown ones are ignored) that overlap the box, in catalog order."""
    found = items if collections is None else items.where(F.col("collection").isin(*collections))
    if bbox is not None:
        found = stac_bbox(found, bbox)
    return found.orderBy("collection_pos", "item_pos").limit(limit)
