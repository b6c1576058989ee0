"""Pixel algebra on rows: masks, index deltas, SSIM, rules, morphology on dense grids."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundshift.functions.columns import ndvi, ndwi, passes, usable
from groundshift.plans.scratch import checked_side, materialize

from . import tiles
from .presets import PRESETS, Preset
from .ranking import order_statistics

KEY = ("aoi_id", "row", "col")
#: Bands of areas up to which their ends are broadcast.
BANDS_BROADCAST = 100_000


def mask_unusable(pairs: DataFrame, bands, classes=("scl",)) -> DataFrame:
    """Null out the bands of pixels that are unusable in either scene."""
    ok = usable(*[F.col(c) for c in classes])
    return pairs.withColumns({b: F.when(ok, F.col(b)) for b in bands})


def pair_scenes(before: DataFrame, after: DataFrame, bands) -> DataFrame:
    """Join two dates on the pixel key; bands get suffixes 0 and 1."""
    named = lambda df, n: df.select(*KEY, *[F.col(b).alias(f"{b}{n}") for b in bands])
    return named(before, 0).join(named(after, 1), list(KEY))


def index_deltas(pairs: DataFrame, classes=("scl",)) -> DataFrame:
    """ndvi and ndwi of both dates and their change, after masking.

    ``classes`` names the class columns, such as one for each date; a pixel must be usable in all.
    """
    ok = usable(*map(F.col, classes))
    at = lambda f, a, b, n: F.when(ok, f(F.col(f"{a}{n}"), F.col(f"{b}{n}")))
    out = pairs.withColumns({
        "ndvi_before": at(ndvi, "red", "nir", 0), "ndvi_after": at(ndvi, "red", "nir", 1), "ndwi_before": at(ndwi, "green", "nir", 0), "ndwi_after": at(ndwi, "green", "nir", 1),
    })
    return out.withColumns({"ndvi": F.col("ndvi_after") - F.col("ndvi_before"), "ndwi": F.col("ndwi_after") - F.col("ndwi_before"), "usable": ok})


def _ssim(grid: tiles.Grid, a: str, b: str) -> np.ndarray:
    return tiles.ssim_dissimilarity(grid.of(a, 0, np.int64), grid.of(b, 0, np.int64))


def ssim_dissimilarity(pairs: DataFrame, a: str = "red0", b: str = "red1") -> DataFrame:
    """aoi_id, row, col, ssim_dissim: one minus the local SSIM of two raw bands, 7 x 7 windows, mirrored border."""
    bands = pairs.select(*KEY, F.col(a).cast("long").alias("_x"), F.col(b).cast("long").alias("_y"))
    return tiles.over_tiles(bands, {"ssim_dissim": "double"}, lambda g: {"ssim_dissim": _ssim(g, "_x", "_y")}, tiles.SSIM_SIDE // 2).select(*KEY, "ssim_dissim")


def change_maps(pairs: DataFrame, presets=PRESETS, classes=("scl",)) -> DataFrame:
    """The pairs with exactly the maps that the presets' rules name, and ``usable``.

    SSIM is taken of the band that the preset of the pixel's vertical names, and by the first
    preset's where there is no such preset. ``classes`` as for ``index_deltas``.
    """
    out, wanted = _with_indices(pairs, presets, classes)
    if "ssim_dissim" not in wanted:
        return out
    found = tiles.over_tiles(out.withColumns({f"_s{n}": _ssim_band(presets, n) for n in "01"}), {"ssim_dissim": "double"}, lambda g: {"ssim_dissim": _ssim(g, "_s0", "_s1")}, tiles.SSIM_SIDE // 2)
    return found.drop("_s0", "_s1")


def _with_indices(pairs: DataFrame, presets, classes) -> tuple[DataFrame, set[str]]:
    """The pairs with ``usable`` and the indices that rules name, and the names of all maps that they name."""
    wanted = {r.map for p in presets for r in p.rules}
    indices = [m for m in ("ndvi", "ndwi", "ndvi_before", "ndwi_before", "ndvi_after", "ndwi_after") if m in wanted]
    return index_deltas(pairs, classes).select(*pairs.columns, "usable", *indices), wanted


def cleaned_maps(pairs: DataFrame, presets=PRESETS, classes=("scl",), ssim_everywhere: bool = True) -> DataFrame:
    """``change_maps`` with ``hit``, the mask of the rules after opening and closing with the preset's sizes, in one exchange.

    SSIM, rules and morphology are one pass over tiles. Without ``ssim_everywhere`` SSIM is taken only in areas of a
    vertical whose preset has a rule on it, and undefined in others.
    """
    out, wanted = _with_indices(pairs, presets, classes)
    of = lambda i, p: reduce(lambda x, y: x & y, [passes(F.col(r.map), r.direction, r.threshold) for r in p.rules if r.map != "ssim_dissim"], F.col("usable"))
    before = F.lit(False)
    for i, p in enumerate(presets):
        before = F.when(F.col("vertical") == i, of(i, p)).otherwise(before)
    bands = {f"_s{n}": _ssim_band(presets, n) for n in "01"} if "ssim_dissim" in wanted else {}
    limits = {i: [r for r in p.rules if r.map == "ssim_dissim"] for i, p in enumerate(presets)}
    with_ssim = bool(bands)

    def work(grid: tiles.Grid) -> dict[str, np.ndarray]:
        vertical, hit = grid.of("vertical", -1, np.int64), grid.of("_rules", False, bool)
        here = [i for i in np.unique(vertical) if i >= 0]
        found = {}
        if with_ssim:
            if ssim_everywhere or any(limits.get(i) for i in here):
                found["ssim_dissim"] = _ssim(grid, "_s0", "_s1")
                for i in here:
                    for r in limits.get(i, ()):
                        v = found["ssim_dissim"]
                        hit &= (vertical != i) | {"increase": v >= r.threshold, "at_least": v >= r.threshold, "decrease": v <= -r.threshold, "at_most": v <= r.threshold}[r.direction]
            else:
                found["ssim_dissim"] = np.full(grid.shape, np.nan)
        sizes = {(presets[i].open_size, presets[i].close_size) for i in here if i < len(presets)}
        found["hit"] = np.zeros(grid.shape, dtype=bool)
        for size in sizes:  # one, unless verticals share an area
            mine = np.isin(vertical, [i for i in here if i < len(presets) and (presets[i].open_size, presets[i].close_size) == size])
            found["hit"] |= tiles.open_close(hit, *size) & mine
        return found

    halo = (tiles.SSIM_SIDE // 2 if bands else 0) + max(tiles.reach_of(p.open_size, p.close_size) for p in presets)
    made = {"ssim_dissim": "double"} if bands else {}
    found = tiles.over_tiles(out.withColumns({"_rules": before} | bands), made | {"hit": "boolean"}, work, halo)
    return found.drop("_rules", *bands)


def _ssim_band(presets, date: str) -> Column:
    """The band of one date that SSIM is taken of, by the pixel's vertical."""
    band = F.col(f"{presets[0].ssim_band}{date}")
    for i, p in enumerate(presets):
        if p.ssim_band != presets[0].ssim_band:
            band = F.when(F.col("vertical") == i, F.col(f"{p.ssim_band}{date}")).otherwise(band)
    return band.alias(f"_s{date}")


def rule_mask(maps: DataFrame, presets=PRESETS) -> DataFrame:
    """``maps`` with hit: usable and all rules of the pixel's vertical (its place in ``presets``)."""
    def of(p: Preset) -> Column:
        return reduce(lambda x, y: x & y, [passes(F.col(r.map), r.direction, r.threshold) for r in p.rules], F.col("usable"))

    hit = F.lit(False)
    for i, p in enumerate(presets):
        hit = F.when(F.col("vertical") == i, of(p)).otherwise(hit)
    return maps.withColumn("hit", hit)


def _morph(mask: DataFrame, col: str, size: int, grow: bool, keys=("aoi_id",), columns_first: bool = True) -> DataFrame:
    """One pass down the columns and one along the rows, in either order: the result is the same."""
    reach, order = size // 2, (("row", "col"), ("col", "row"))
    for axis, other in order if columns_first else order[::-1]:
        frame = Window.partitionBy(*keys, other).orderBy(axis).rangeBetween(-reach, reach)
        value = F.max(col).over(frame) if grow else F.min(col).over(frame) & (F.count(F.lit(1)).over(frame) == 2 * reach + 1)
        mask = mask.withColumn(col, value)
    return mask


def binary_erosion(mask: DataFrame, col: str = "hit", size: int = 3, keys=("aoi_id",)) -> DataFrame:
    """True where the whole size x size square is; outside of the grid counts as false."""
    return _morph(mask, col, size, False, keys)


def binary_dilation(mask: DataFrame, col: str = "hit", size: int = 3, keys=("aoi_id",)) -> DataFrame:
    """True where any of the size x size square is."""
    return _morph(mask, col, size, True, keys)


def clean_mask(mask: DataFrame, col: str = "hit", open_size: int = 3, close_size: int = 3, keys=("aoi_id",)) -> DataFrame:
    """Opening, then closing; a size of 1 or less skips its step.

    One pass over tiles; null counts as false, and so does what lies outside of the grid.
    """
    return tiles.over_tiles(mask, {col: "boolean"}, lambda g: {col: tiles.open_close(g.of(col, False, bool), open_size, close_size)}, tiles.reach_of(open_size, close_size), keys)


def clean_levels(levels: DataFrame, col: str, open_size: int = 3, close_size: int = 3, keys=("aoi_id",)) -> DataFrame:
    """The greatest threshold at which the cleaned mask ``col >= threshold`` holds each pixel; null where none does.

    ``clean_mask`` of every threshold at once: flat openings and closings commute with thresholds.
    """
    def work(grid: tiles.Grid) -> dict[str, np.ndarray]:
        found = tiles.open_close(grid.of(col, -np.inf, np.float64), open_size, close_size)
        return {col: np.where(np.isneginf(found), np.nan, found)}

    return tiles.over_tiles(levels, {col: "double"}, work, tiles.reach_of(open_size, close_size), keys)


def percentile_stretch(bands: DataFrame, low: float = 2.0, high: float = 98.0, gamma: float = 1.0, fixed_max: float | None = None) -> DataFrame:
    """Rows (aoi_id, row, col, band, value) with level 0 to 255 between the band's percentiles.

    ``fixed_max`` anchors the range at 0 and that value instead. An undefined value or an empty
    range is level 0.
    """
    if fixed_max is None:
        ends = materialize(order_statistics(bands, ["aoi_id", "band"], "value", [low / 100, high / 100]), "stretch")
        ends = ends.select("aoi_id", "band", F.col("q0").alias("lo"), F.col("q1").alias("hi"))
        joined = bands.join(checked_side(ends, ends.count(), BANDS_BROADCAST), ["aoi_id", "band"], "left")
    else:
        joined = bands.withColumns({"lo": F.lit(0.0), "hi": F.lit(float(fixed_max))})
    part = F.least(F.greatest(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    level = F.when((F.col("hi") > F.col("lo")) & F.col("value").isNotNull(), F.floor(F.pow(part, F.lit(gamma)) * 255.0 if gamma != 1.0 else part * 255.0)).otherwise(0)
    return joined.select("aoi_id", "row", "col", "band", level.cast("int").alias("level"))
