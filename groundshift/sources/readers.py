"""File sources: catalogue items, article lists, truth features; sinks for features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Assets a scene keeps (fixed list).
KEPT_ASSETS = ("red", "green", "blue", "nir", "scl")
ITEM = (
    "id string, collection string, bbox array<double>, properties struct<`datetime`: string, `eo:cloud_cover`: double, `proj:epsg`: int, `proj:code`: string, "
    "`s2:processing_baseline`: string, `earthsearch:boa_offset_applied`: boolean>, assets map<string, struct<href: string>>"
)
ARTICLE_LIST = "struct<articles: array<struct<url: string, title: string, seendate: string, domain: string, language: string>>>"
FEATURES = "type string, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue item files, one JSON document each."""
    return spark.read.schema(ITEM).option("multiLine", True).json(path)


def items_from_json(df: DataFrame, col: str = "item") -> DataFrame:
    """Catalogue items from a column of JSON text."""
    return df.select(F.from_json(col, ITEM_STRUCT).alias("i")).select("i.*")


ITEM_STRUCT = "struct<" + ITEM.replace("id string, collection string, bbox array<double>, properties struct", "id: string, collection: string, bbox: array<double>, properties: struct").replace(", assets map", ", assets: map") + ">"


def _prop(name: str) -> Column:
    return F.col("properties").getField(name)


def scene_epsg() -> Column:
    """``proj:epsg``, else the number of ``proj:code`` "EPSG:n", else null; 0 counts as missing."""
    own = F.when(_prop("proj:epsg") != 0, _prop("proj:epsg"))
    return F.coalesce(own, F.regexp_extract(F.coalesce(_prop("proj:code"), F.lit("")), r"^EPSG:(\d+)$", 1).try_cast("int"))


def boa_offset() -> Column:
    """-1000 from baseline 4.0 on unless the offset was already applied, else 0; an unreadable baseline counts as 0."""
    baseline = F.coalesce(F.trim(_prop("s2:processing_baseline")).try_cast("double"), F.lit(0.0))
    return F.when((baseline >= 4.0) & ~F.coalesce(_prop("earthsearch:boa_offset_applied"), F.lit(False)), -1000).otherwise(0)


def scenes_from_items(items: DataFrame) -> DataFrame:
    """Scene rows: stac_id, collection, captured_at, cloud_pct, epsg, assets (kept ones), dn_offset, error.

    ``error`` names what makes an item unusable: no datetime or no projection.
    """
    epsg, at = scene_epsg(), F.try_to_timestamp(_prop("datetime"))
    kept = F.transform_values(F.map_filter("assets", lambda k, v: k.isin(*KEPT_ASSETS)), lambda k, v: v["href"])
    return items.select(
        F.col("id").alias("stac_id"), F.coalesce("collection", F.lit("sentinel-2-l2a")).alias("collection"), at.alias("captured_at"), _prop("eo:cloud_cover").alias("cloud_pct"),
        epsg.alias("epsg"), kept.alias("assets"), boa_offset().alias("dn_offset"), F.when(at.isNull(), "no datetime").when(epsg.isNull(), "no projection").alias("error"),
    )


def read_article_lists(spark: SparkSession, path: str) -> DataFrame:
    """Response bodies, one file each, as the column ``body``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def articles_from_artlist(bodies: DataFrame) -> DataFrame:
    """Articles of response bodies: url, title, seendate, domain, language.

    A body that is not JSON is an empty list; an article without url, title or a readable compact
    time stamp is dropped; titles are trimmed.
    """
    rows = bodies.select(F.explode(F.from_json("body", ARTICLE_LIST)["articles"]).alias("a")).select("a.*")
    seen = F.try_to_timestamp(F.col("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    out = rows.select("url", F.trim("title").alias("title"), seen.alias("seendate"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("language", F.lit("")).alias("language"))
    return out.where("url is not null and title is not null and seendate is not null")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection files of polygons."""
    return spark.read.schema(FEATURES).option("multiLine", True).json(path)


def truth_from_geojson(collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributes, edges) of the polygons of feature collections.

    ``collections`` has a column ``source``, the features, and gives attribute rows (source,
    feature, properties) and edge rows (source, feature, ring, seq, x0, y0, x1, y1).
    """
    each = collections.select("source", F.posexplode("features").alias("feature", "f"))
    attributes = each.select("source", "feature", F.col("f.properties").alias("properties"))
    rings = each.select("source", "feature", F.posexplode("f.geometry.coordinates").alias("ring", "points"))
    pairs = F.arrays_zip(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))).alias("a"), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))).alias("b"))
    edges = rings.select("source", "feature", "ring", F.posexplode(pairs).alias("seq", "e"))
    return attributes, edges.select("source", "feature", "ring", "seq", *[F.get(F.col(f"e.{p}"), i).alias(f"{axis}{n}") for n, p in enumerate("ab") for i, axis in enumerate("xy")])


def geojson_features(rows: DataFrame, rings: Column, properties: list[str]) -> DataFrame:
    """One column ``feature``: each row as a GeoJSON Feature with its rings and properties."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """Write features as JSON lines."""
    features.select("feature").write.mode("overwrite").text(path)
