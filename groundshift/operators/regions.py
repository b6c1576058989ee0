"""Connected regions of a mask, their statistics, outlines and filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundshift.plans.scratch import materialize

from . import tiles
from .components import connected_components
from .pixels import cleaned_maps
from .presets import PRESETS
from .rings import polygons_to_wgs84, region_polygons, region_rings

__all__ = ["connected_regions", "detect_changes", "detection_geometry", "keep_near_largest", "materialize", "min_area_filter", "region_outline", "region_rings", "region_runs", "region_stats", "row_runs"]

PIXEL_M = 10.0
_BITS = 20  # of row and column in the number of a run; the rest is left for the area


def row_runs(mask: DataFrame, col: str = "hit") -> DataFrame:
    """Maximal horizontal runs of true pixels: aoi_id, row, lo, hi."""
    island = F.col("col") - F.row_number().over(Window.partitionBy("aoi_id", "row").orderBy("col"))
    on = mask.where(F.col(col)).select("aoi_id", "row", "col", island.alias("island"))
    return on.groupBy("aoi_id", "row", "island").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).drop("island")


def _node(row: Column, lo: Column) -> Column:
    node = F.shiftleft(row.cast("long"), _BITS).bitwiseOR(lo.cast("long"))
    return F.when((row < 1 << _BITS) & (lo < 1 << _BITS), node).otherwise(F.raise_error(F.lit("a grid may have at most 2^20 rows and columns")))


def region_runs(mask: DataFrame, col: str = "hit") -> DataFrame:
    """Runs with region_id, the number of the least (row, lo) run that is 4-connected to them.

    Runs of adjacent rows that share a column are edges; components are contracted on runs, with
    ids made unique over all areas by numbering the runs' places.
    """
    runs = materialize(row_runs(mask, col).withColumn("region_id", _node(F.col("row"), F.col("lo"))), "runs")
    up = runs.select("aoi_id", (F.col("row") + 1).alias("row"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("region_id").alias("above"))
    edges = runs.join(up.hint("merge"), ["aoi_id", "row"]).where("lo <= hi2 and lo2 <= hi")
    span = F.lit(1 << (2 * _BITS))
    wide = lambda c: F.col("aoi_id").cast("long") * span + F.col(c)
    found = connected_components(edges.select(wide("region_id").alias("a"), wide("above").alias("b")))
    labelled = runs.withColumn("node", wide("region_id")).join(found.hint("merge"), "node", "left")
    return labelled.select("aoi_id", "row", "lo", "hi", F.coalesce(F.pmod(F.col("root"), span), F.col("region_id")).alias("region_id"))


def connected_regions(mask: DataFrame, col: str = "hit") -> DataFrame:
    """aoi_id, row, col, region_id of every true pixel, as a written table of known size."""
    return materialize(region_runs(mask, col).select("aoi_id", "row", F.explode(F.sequence("lo", "hi")).alias("col"), "region_id"), "labels")


def region_stats(maps: DataFrame, labels: DataFrame, presets=PRESETS, pixel_area: float = PIXEL_M * PIXEL_M) -> DataFrame:
    """One row per region: vertical, n_pixels, area_m2, magnitude, confidence and the mean of each map.

    Undefined values are left out of means; a region without any defined value has 0.
    """
    names = sorted({r.map for p in presets for r in p.rules})
    value = confirm = F.lit(None)
    for i, p in enumerate(presets):
        v, r = F.col(p.primary_map), p.primary
        on = v <= -r.threshold if r.direction == "decrease" else v >= r.threshold
        value = F.when(F.col("vertical") == i, v).otherwise(value)
        confirm = F.when(F.col("vertical") == i, F.when(v.isNotNull(), on.cast("double"))).otherwise(confirm)
    rows = labels.join(maps, ["aoi_id", "row", "col"]).withColumns({"_v": value, "_c": confirm})
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.groupBy("aoi_id", "region_id").agg(
        F.first("vertical").alias("vertical"), F.count(F.lit(1)).alias("n_pixels"), (F.count(F.lit(1)) * F.lit(pixel_area)).alias("area_m2"),
        mean(F.abs("_v")).alias("magnitude"), mean("_c").alias("confidence"), *[mean(n).alias(f"mean_{n}") for n in names],
    )


def min_area_filter(stats: DataFrame, presets=PRESETS) -> DataFrame:
    """Regions of at least their preset's floor; equality stays."""
    floor = F.lit(None)
    for i, p in enumerate(presets):
        floor = F.when(F.col("vertical") == i, F.lit(p.min_area_m2)).otherwise(floor)
    return stats.where(F.col("area_m2") >= floor)


def region_outline(labels: DataFrame) -> DataFrame:
    """Boundary edges in pixel corners, the region on the left: aoi_id, region_id, r0, c0, r1, c1."""
    r, c = F.col("row"), F.col("col")
    side = lambda dr, dc, a, b, x, y: F.struct((r + dr).alias("row"), (c + dc).alias("col"), (r + a).alias("r0"), (c + b).alias("c0"), (r + x).alias("r1"), (c + y).alias("c1"))
    sides = F.array(side(-1, 0, 0, 1, 0, 0), side(1, 0, 1, 0, 1, 1), side(0, -1, 0, 0, 1, 0), side(0, 1, 1, 1, 0, 1))
    each = labels.select("aoi_id", "region_id", F.explode(sides).alias("s")).select("aoi_id", "region_id", "s.*")
    return each.join(labels.hint("merge"), ["aoi_id", "region_id", "row", "col"], "left_anti").select("aoi_id", "region_id", "r0", "c0", "r1", "c1")


#: Pixels of a radius up to which nearness is looked for in tiles, whose halo it is.
NEAR_PIXELS = 1024


def _near(grid: tiles.Grid, pixel: float, reach: int) -> np.ndarray:
    """Boundary pixels whose gap to an anchor pixel is within their radius, by a distance transform of two passes.

    Down the columns each pixel learns the row of the nearest anchor; along the rows the least of the gaps to the
    columns within reach counts. Pixels are squares, so neighbours have no gap.
    """
    anchor, radius = grid.of("_anchor", False, bool), grid.of("_radius", -1.0, np.float64)
    present = np.zeros(grid.shape, dtype=bool)
    present.ravel()[grid.at] = True
    near = np.zeros(grid.shape, dtype=bool)
    if not anchor.any():
        return near
    lines = np.arange(grid.shape[0], dtype=np.int64)[:, None]
    far = np.int64(1 << 30)
    above = lines - np.maximum.accumulate(np.where(anchor, lines, -far), axis=0)
    below = np.minimum.accumulate(np.where(anchor, lines, far)[::-1], axis=0)[::-1] - lines
    rows = np.maximum(np.minimum(above, below) - 1, 0).astype(np.float64)
    wide = np.pad(rows, ((0, 0), (reach, reach)), constant_values=float(far))
    inside = np.pad(present, 1)
    r, c = np.nonzero(present & ~(inside[:-2, 1:-1] & inside[2:, 1:-1] & inside[1:-1, :-2] & inside[1:-1, 2:]) & (radius >= 0))
    columns = np.maximum(np.abs(np.arange(-reach, reach + 1)) - 1, 0).astype(np.float64) ** 2
    for at in range(0, len(r), 4096):
        i, j = r[at : at + 4096], c[at : at + 4096]
        gap = (wide[i[:, None], j[:, None] + np.arange(2 * reach + 1)] ** 2 + columns).min(axis=1)
        near[i, j] = pixel * np.sqrt(gap) <= radius[i, j]
    return near


def keep_near_largest(stats: DataFrame, labels: DataFrame, presets=PRESETS, pixel: float = PIXEL_M) -> DataFrame:
    """Regions within the preset's radius of their area's largest, edge to edge; no radius keeps all.

    The first of equal largest regions is the anchor. The distance of two regions is the least gap between their pixels.
    It is looked for in tiles whose halo is the greatest radius, at most ``NEAR_PIXELS`` pixels; the work of a
    tile is linear in its boundary pixels.
    """
    radius = F.lit(None).cast("double")
    for i, p in enumerate(presets):
        radius = F.when(F.col("vertical") == i, F.lit(p.focus_radius_m).cast("double")).otherwise(radius)
    reach = int(max([p.focus_radius_m or 0.0 for p in presets]) / pixel) + 2
    if reach > NEAR_PIXELS:
        raise ValueError(f"a radius may be of {NEAR_PIXELS} pixels at most")
    ranked = stats.withColumn("_radius", radius)
    anchors = ranked.groupBy("aoi_id").agg(F.min_by("region_id", F.struct(-F.col("area_m2"), "region_id")).alias("_anchor_id"))
    ranked = materialize(ranked.join(anchors.hint("merge"), "aoi_id").withColumn("_anchor", F.col("region_id") == F.col("_anchor_id")), "near-ranked")
    asked = ranked.where("_radius is not null").select("aoi_id", "region_id", "_radius", "_anchor")
    pixels = labels.select("aoi_id", "region_id", "row", "col").join(asked.hint("merge"), ["aoi_id", "region_id"])
    found = tiles.over_tiles(pixels, {"near": "boolean"}, lambda g: {"near": _near(g, pixel, reach)}, reach, side=max(tiles.TILE, 2 * reach + 1))
    close = found.where("near").select("aoi_id", "region_id").distinct().withColumn("_close", F.lit(True))
    out = ranked.join(close.hint("merge"), ["aoi_id", "region_id"], "left").where("_radius is null or _anchor or _close")
    return out.select(*stats.columns)


def detect_changes(pairs: DataFrame, presets=PRESETS, classes=("scl",)) -> tuple[DataFrame, DataFrame]:
    """(detections, labels): regions after rules, cleaning, area floor and focus, and their pixels.

    All areas run in one job; ``labels`` holds the pixels of the regions that stay. ``classes``
    names the class columns of both dates; a pixel must be usable in all.
    """
    maps = materialize(cleaned_maps(pairs, presets, classes), "maps")
    labels = connected_regions(maps.select("aoi_id", "row", "col", "hit"))
    large = materialize(min_area_filter(region_stats(maps, labels, presets), presets), "regions")
    kept = keep_near_largest(large, labels.join(large.select("aoi_id", "region_id"), ["aoi_id", "region_id"]), presets)
    types = F.lit(None).cast("string")
    for i, p in enumerate(presets):
        types = F.when(F.col("vertical") == i, F.lit(p.change_type)).otherwise(types)
    kept = materialize(kept.withColumn("change_type", types), "detections")
    return kept, labels.join(kept.select("aoi_id", "region_id"), ["aoi_id", "region_id"])


def detection_geometry(labels: DataFrame, grids: DataFrame, pixel: float = PIXEL_M) -> DataFrame:
    """Polygons of the detections whose pixels are ``labels``: aoi_id, region_id, area_m2, n_rings, rings and geometry.

    ``grids`` as for ``rings.polygons_to_wgs84``; geometry is GeoJSON in longitude and latitude, area_m2 that of the pixel polygon.
    """
    return polygons_to_wgs84(materialize(region_polygons(region_outline(labels), pixel * pixel), "polygons"), grids)
