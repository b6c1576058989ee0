"""Accuracy scoring: confusion counts, ratios, sweeps, diagnosis, truth identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundshift.functions.columns import usable

from .pixels import clean_levels
from .presets import PRESETS


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_ratios(counts: DataFrame) -> DataFrame:
    """Rows with tp, fp, fn: precision, recall, f1 and iou added; an undefined ratio is 0."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "iou": _ratio(tp, tp + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * p * r, p + r))


def confusion_counts(pixels: DataFrame, keys=("aoi_id",)) -> DataFrame:
    """tp, fp, fn, tn over the valid pixels of rows with predicted, truth and valid."""
    p, t, v = (F.coalesce(c, F.lit(False)) for c in ("predicted", "truth", "valid"))
    return pixels.groupBy(*keys).agg(F.count_if(v & p & t).alias("tp"), F.count_if(v & p & ~t).alias("fp"), F.count_if(v & ~p & t).alias("fn"), F.count_if(v & ~p & ~t).alias("tn"))


def micro_average(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts pooled on every level of ``keys`` (null stands for all) with their ratios."""
    pooled = counts.rollup(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).na.fill(0, ["tp", "fp", "fn", "tn"])
    return score_ratios(pooled)


def emitted_mask(pixels: DataFrame, kept_labels: DataFrame) -> DataFrame:
    """pixels with predicted: the pixel belongs to a region that was emitted."""
    on = kept_labels.select("aoi_id", "row", "col", F.lit(True).alias("_on"))
    return pixels.join(on.hint("merge"), ["aoi_id", "row", "col"], "left").withColumn("predicted", F.coalesce("_on", F.lit(False))).drop("_on")


def threshold_sweep(maps: DataFrame, thresholds: list[float], map_name: str = "ssim_dissim", vertical: int = 0) -> DataFrame:
    """The pixels of one vertical's cleaned masks: threshold, aoi_id, row, col of those that are hit.

    One pass of grey-scale morphology gives each pixel the greatest threshold at which it stays,
    whatever the number of thresholds; a pixel then is a row for each threshold below that.
    """
    level = F.when(F.col("usable"), F.col(map_name))
    preset = PRESETS[vertical]
    kept = clean_levels(maps.where(F.col("vertical") == vertical).select("aoi_id", "row", "col", level.alias("level")), "level", preset.open_size, preset.close_size)
    passed = F.filter(F.array(*map(F.lit, sorted(thresholds))), lambda t: t <= F.col("level"))
    return kept.where("level is not null").select(F.explode(passed).alias("threshold"), "aoi_id", "row", "col")


def sweep_counts(emitted: DataFrame, pixels: DataFrame, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn, tn of every threshold; ``emitted`` has threshold, truth and valid of emitted pixels, ``pixels`` truth and valid of all."""
    t, v = F.coalesce("truth", F.lit(False)), F.coalesce("valid", F.lit(False))
    found = emitted.groupBy("threshold").agg(F.count_if(v & t).alias("tp"), F.count_if(v & ~t).alias("fp"))
    every = pixels.agg(F.count_if(v & t).alias("truths"), F.count_if(v & ~t).alias("others")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    tp, fp = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp"))
    return every.join(found.hint("merge"), "threshold", "left").select("threshold", tp.alias("tp"), fp.alias("fp"), (F.col("truths") - tp).alias("fn"), (F.col("others") - fp).alias("tn"))


def water_sensitivity(pixels: DataFrame, ndwi_floor: float = -0.05, water_class: int = 6) -> DataFrame:
    """Scores per area after water before the event leaves the truth, by index and by class, and the overlaps.

    ``pixels`` has predicted, truth, valid, ndwi_before and scl0; an undefined index is -1.
    """
    p, t, v = (F.coalesce(c, F.lit(False)) for c in ("predicted", "truth", "valid"))
    by_index, by_class = F.coalesce("ndwi_before", F.lit(-1.0)) > ndwi_floor, F.col("scl0") == water_class

    def counts(name: str, water: Column) -> list[Column]:
        kept = t & ~water
        return [F.count_if(v & p & kept).alias(f"{name}_tp"), F.count_if(v & p & ~kept).alias(f"{name}_fp"), F.count_if(v & ~p & kept).alias(f"{name}_fn"), _ratio(100 * F.count_if(v & t & water), F.count_if(v & t)).alias(f"{name}_overlap_pct")]

    return pixels.groupBy("aoi_id").agg(*counts("ndwi", by_index), *counts("scl", by_class))


def diagnose_detections(pixels: DataFrame, kept_labels: DataFrame) -> DataFrame:
    """Per emitted region: valid pixels, truth pixels and the class of their overlap."""
    met = kept_labels.join(pixels.select("aoi_id", "row", "col", "truth", "valid").hint("merge"), ["aoi_id", "row", "col"])
    t, v = F.coalesce("truth", F.lit(False)), F.coalesce("valid", F.lit(False))
    out = met.groupBy("aoi_id", "region_id").agg(F.count_if(v).alias("valid_pixels"), F.count_if(t & v).alias("truth_pixels"))
    kind = F.when(F.col("valid_pixels") == 0, "no_valid_pixels").when(F.col("truth_pixels") == 0, "zero_truth_overlap").when(F.col("truth_pixels") == F.col("valid_pixels"), "full_truth_overlap").otherwise("partial_truth_overlap")
    return out.withColumn("overlap", kind)


def benchmark_summary(pixels: DataFrame, detections: DataFrame, pixel_area: float = 100.0) -> DataFrame:
    """Per area: truth hectares on valid pixels, valid share, detections, emitted hectares, counts and ratios."""
    t, v = F.coalesce("truth", F.lit(False)), F.coalesce("valid", F.lit(False))
    base = pixels.groupBy("aoi_id").agg((F.count_if(t & v) * pixel_area / 10000).alias("truth_ha"), F.avg(v.cast("double")).alias("valid_share"))
    found = detections.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("detections"), (F.sum("area_m2") / 10000).alias("emitted_ha"))
    out = base.join(found, "aoi_id", "left").join(score_ratios(confusion_counts(pixels)), "aoi_id")
    return out.withColumns({"detections": F.coalesce("detections", F.lit(0)), "emitted_ha": F.coalesce("emitted_ha", F.lit(0.0))})


def preexisting_water_share(pixels: DataFrame, ndwi_floor: float = -0.05) -> DataFrame:
    """Share of each area's emitted pixels that were water before."""
    return pixels.where("predicted").groupBy("aoi_id").agg(_ratio(F.count_if(F.coalesce("ndwi_before", F.lit(-1.0)) > ndwi_floor), F.count(F.lit(1))).alias("water_share"))


def valid_pixels(pairs: DataFrame, classes=("scl",)) -> DataFrame:
    """pairs with valid: usable by all of the class columns."""
    return pairs.withColumn("valid", usable(*map(F.col, classes)))


#: What flood and increment truth must say (fixed values).
FLOOD_TRUTH = {"det_method": "Semi-automatic extraction", "flood_type": "Inland flood"}
INCREMENT_CLASS, INCREMENT_SOURCE = "DESMATAMENTO", "amazonia"


def truth_identity(features: DataFrame, expected_aoi: str, expected_date: str) -> DataFrame:
    """features with ``reject``: the first reason a flood feature is no truth, or null."""
    area = F.col("area_ha").try_cast("double")
    bad = (
        F.when(~F.col("feature_aoi").eqNullSafe(F.lit(expected_aoi)), "aoi").when(~F.try_to_date(F.col("source_dat"), "dd/MM/yyyy").eqNullSafe(F.lit(expected_date).cast("date")), "date")
        .when(~F.col("det_method").eqNullSafe(F.lit(FLOOD_TRUTH["det_method"])), "method").when(~F.col("flood_type").eqNullSafe(F.lit(FLOOD_TRUTH["flood_type"])), "type")
        .when(area.isNull() | F.isnan(area) | (area <= 0), "area").when(~F.coalesce(F.col("has_geometry"), F.lit(False)), "geometry")
    )
    return features.withColumn("reject", bad)


def increment_identity(features: DataFrame, year: int, state: str = "PA") -> DataFrame:
    """Increments of a year and state with ``reject``: the first reason, a repeated uuid last, or null."""
    mine = features.where((F.col("year").try_cast("int") == year) & (F.upper(F.trim("state")) == state))
    area, uuid = F.col("area_km").try_cast("double"), F.trim(F.coalesce("uuid", F.lit("")))
    bad = (
        F.when(~F.col("main_class").eqNullSafe(F.lit(INCREMENT_CLASS)), "main class").when(~F.col("class_name").eqNullSafe(F.lit(f"d{year}")), "class name")
        .when(F.lower(F.trim(F.coalesce("source", F.lit("")))) != INCREMENT_SOURCE, "source").when(area.isNull() | F.isnan(area) | (F.abs(area) == float("inf")) | (area <= 0), "area")
        .when(F.try_to_date(F.col("image_date").cast("string"), "yyyyMMdd").isNull(), "date").when(uuid == "", "uuid").when(F.col("_repeated"), "duplicate uuid")
    )
    # counted before the shuffle, so that one uuid (or the blank one) of many rows is no single task
    repeated = mine.where(uuid != "").groupBy(uuid.alias("_uuid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_uuid", F.lit(True).alias("_repeated"))
    return mine.join(repeated, uuid == F.col("_uuid"), "left").select(*mine.columns, bad.alias("reject"))


def truth_date_bracket(truth: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: truth dates outside its two dates, sorted, and whether it has no truth at all."""
    met = windows.join(truth, "aoi_id", "left")
    outside = F.when((F.col("image_date") < F.col("before_date")) | (F.col("image_date") > F.col("after_date")), F.col("image_date"))
    return met.groupBy("aoi_id").agg(F.array_sort(F.collect_set(outside)).alias("outside"), (F.count("image_date") == 0).alias("no_truth"))


def combined_bounds(bounds: DataFrame) -> DataFrame:
    return bounds.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def run_drift(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """metric, stored, fresh and their absolute difference, from two (metric, value) tables."""
    a, b = stored.withColumnRenamed("value", "stored"), fresh.withColumnRenamed("value", "fresh")
    return a.join(b, "metric", "full_outer").withColumn("drift", F.abs(F.col("stored") - F.col("fresh")))
