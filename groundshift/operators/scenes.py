"""Scene search, gating, selection and harmonising."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundshift.functions.columns import usable

MIN_USABLE = 0.7
WIDEN_STEP_DAYS, WIDEN_CAP_DAYS = 15, 60
SEARCH_LIMIT = 64
ABSENT_SHARE = 0.5


def candidate_windows(requests: DataFrame) -> DataFrame:
    """aoi_id, step, start, end: the asked window and those with a later end; reversed windows are left out."""
    steps = F.sequence(F.lit(0), F.lit(WIDEN_CAP_DAYS), F.lit(WIDEN_STEP_DAYS))
    rows = requests.where(F.col("start") <= F.col("end")).select("aoi_id", "start", "end", F.explode(steps).alias("step"))
    return rows.select("aoi_id", "step", "start", F.date_add("end", F.col("step")).alias("end"))


def scene_search(scenes: DataFrame, requests: DataFrame, max_cloud: float = 100.0, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Scenes of a request's area and days, under a cloud cap (100 or more is none), oldest first, at most ``limit``."""
    day = F.to_date("captured_at")
    found = scenes.join(requests, "aoi_id").where((day >= F.col("start")) & (day <= F.col("end")))
    if max_cloud < 100:
        found = found.where(F.col("cloud_pct") < max_cloud)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("aoi_id").orderBy("captured_at", "scene_id")))
    return found.where(F.col("place") <= limit)


def usable_fraction(pixels: DataFrame) -> DataFrame:
    """Share of usable pixels per area; an area without pixels does not occur (0 after a left join)."""
    return pixels.groupBy("aoi_id").agg(F.avg(usable(F.col("scl")).cast("double")).alias("usable_fraction"))


def requested_scenes(scenes: DataFrame, requests: DataFrame, min_usable: float = MIN_USABLE) -> DataFrame:
    """Usable scenes in the windows of their area's request, with step, by how many days the narrowest of the ``candidate_windows`` that holds it is wider."""
    day = F.to_date("captured_at")
    late = F.greatest(F.datediff(day, F.col("end")), F.lit(0))
    met = scenes.join(requests.where(F.col("start") <= F.col("end")), "aoi_id").withColumn("step", (F.ceil(late / WIDEN_STEP_DAYS) * WIDEN_STEP_DAYS).cast("int"))
    return met.where((day >= F.col("start")) & (F.col("step") <= WIDEN_CAP_DAYS) & (F.col("usable_fraction") >= min_usable))


def select_usable_scene(scenes: DataFrame, requests: DataFrame, min_usable: float = MIN_USABLE) -> DataFrame:
    """The scene each request takes: narrowest window first, then least cloud, earliest, id.

    A scene counts in the narrowest of the ``candidate_windows`` that holds it; scenes under ``min_usable`` are passed over.
    """
    met = requested_scenes(scenes, requests, min_usable)
    best = F.min_by(F.struct("scene_id", "step", "cloud_pct", "usable_fraction"), F.struct("step", "cloud_pct", "captured_at", "scene_id"))
    return met.groupBy("aoi_id").agg(best.alias("b")).select("aoi_id", "b.*")


def pin_scene(specs: DataFrame, scenes: DataFrame, min_usable: float = MIN_USABLE) -> DataFrame:
    """spec_id, stac_id, day and status of exactly the named scenes: found, missing, below usable minimum."""
    named = scenes.select("stac_id", F.to_date("captured_at").alias("day"), "usable_fraction").groupBy("stac_id", "day").agg(F.max("usable_fraction").alias("usable_fraction"))
    status = F.when(F.col("usable_fraction").isNull(), "missing").when(F.col("usable_fraction") < min_usable, "below usable minimum").otherwise("found")
    return specs.join(named, ["stac_id", "day"], "left").select("spec_id", "stac_id", "day", status.alias("status"))


def window_clip(bounds: DataFrame) -> DataFrame:
    """Pixel window of bounds on a grid (a, e, x0, y0), rounded outward: row_off, col_off, row_end, col_end."""
    return bounds.select(
        "aoi_id", F.floor((F.col("y0") - F.col("maxy")) / F.abs("e")).alias("row_off"), F.floor((F.col("minx") - F.col("x0")) / F.col("a")).alias("col_off"),
        F.ceil((F.col("y0") - F.col("miny")) / F.abs("e")).alias("row_end"), F.ceil((F.col("maxx") - F.col("x0")) / F.col("a")).alias("col_end"),
    )


def read_window(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    """The pixels of each area's window."""
    met = pixels.join(windows, "aoi_id")
    return met.where("row >= row_off and row < row_end and col >= col_off and col < col_end").select(*pixels.columns)


def coverage_check(windows: DataFrame, headers: DataFrame) -> DataFrame:
    """windows with ``covered``: the window lies within the grid's height and width."""
    return windows.join(headers, "aoi_id").withColumn("covered", F.expr("row_off >= 0 and col_off >= 0 and row_end <= height and col_end <= width"))


def scl_resample(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Class of each 10 m pixel from the nearest one of the 20 m grid (row, col, scl of ``coarse``)."""
    half = lambda c: F.floor((F.col(c) + 0.5) / 2).cast("int")
    side = coarse.select("aoi_id", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("scl").alias("scl20"))
    return fine.withColumns({"r2": half("row"), "c2": half("col")}).join(side, ["aoi_id", "r2", "c2"]).drop("r2", "c2")


def msi_band_select(stacks: DataFrame, col: str = "planes") -> DataFrame:
    """Named bands of a stack of 13 planes; every pixel counts clear. Stacks of another size are left out."""
    at = {"blue": 2, "green": 3, "red": 4, "nir": 8}
    ok = stacks.where(F.size(col) == 13)
    return ok.select(*[c for c in stacks.columns if c != col], *[F.element_at(col, i).alias(b) for b, i in at.items()], F.lit(4).alias("scl"))


def decode_labels(labels: DataFrame) -> DataFrame:
    """aoi_id, row, col, changed: 2 is changed, 1 is not; an area with any other value is left out."""
    sound = labels.groupBy("aoi_id").agg(F.bool_and(F.coalesce(F.col("value").isin(1, 2), F.lit(False))).alias("ok")).where("ok").select("aoi_id")
    return labels.join(sound, "aoi_id").select("aoi_id", "row", "col", (F.col("value") == 2).alias("changed"))


def acquisition_variants(scenes: DataFrame) -> DataFrame:
    """Acquisitions (platform, tile, day) with several items: how many, and whom each selector takes."""
    p = F.split("stac_id", "_")
    rows = scenes.select(p[0].alias("platform"), p[1].alias("tile"), p[2].alias("day"), "scene_id", "cloud_pct", "captured_at")
    out = rows.groupBy("platform", "tile", "day").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("captured_at", "scene_id"))["scene_id"].alias("first_item"), F.min(F.struct("cloud_pct", "scene_id"))["scene_id"].alias("clearest_item"))
    return out.where("n > 1")


def harmonize(bands: DataFrame, offsets: DataFrame) -> DataFrame:
    """Long band rows (aoi_id, row, col, band, value) with the scene's offset added, not below 0.

    Skipped for a scene if over half of its valid samples are at most the offset's size: its
    numbers already lack it. Offset 0 changes nothing.
    """
    valid = bands.where("value > 0").join(offsets, "aoi_id")
    share = valid.groupBy("aoi_id").agg(F.avg((F.col("value") <= F.abs("dn_offset")).cast("double")).alias("low_share"))
    scene = offsets.join(share, "aoi_id", "left")
    absent = (F.col("dn_offset") < 0) & (F.coalesce("low_share", F.lit(0.0)) > ABSENT_SHARE)
    scene = scene.select("aoi_id", F.when(absent, 0).otherwise(F.col("dn_offset")).alias("applied"))
    moved = F.when(F.col("applied") == 0, F.col("value")).otherwise(F.greatest(F.col("value") + F.col("applied"), F.lit(0)))
    return bands.join(scene, "aoi_id").select("aoi_id", "row", "col", "band", moved.alias("value"), "applied")


def long_bands(pixels: DataFrame, columns: list[str]) -> DataFrame:
    return pixels.unpivot(["aoi_id", "row", "col"], columns, "band", "value")


def scene_meta_backfill(rows: DataFrame) -> DataFrame:
    """stac_id, collection, epsg, cloud of stored JSON meta, missing keys from the row's own columns."""
    m = F.from_json("meta", "collection string, epsg int, cloud_pct double")
    return rows.select("scene_id", F.coalesce(m["collection"], F.lit("sentinel-2-l2a")).alias("collection"), F.coalesce(m["epsg"], F.col("own_epsg")).alias("epsg"), F.coalesce(m["cloud_pct"], F.col("own_cloud")).alias("cloud_pct"))


def coregistration_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """aoi_id and the first thing that differs between two grid headers (crs, shape, transform), or null."""
    names = ("epsg", "height", "width", "a", "e", "x0", "y0")
    b = before.select("aoi_id", *[F.col(c).alias(f"{c}_b") for c in names])
    differ = lambda *cs: ~F.least(*[F.lit(True), *[F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in cs]])
    return after.join(b, "aoi_id").select("aoi_id", F.when(differ("epsg"), "crs").when(differ("height", "width"), "shape").when(differ("a", "e", "x0", "y0"), "transform").alias("error"))


def pair_scene_list(scenes: DataFrame, active: DataFrame) -> DataFrame:
    """Scenes of each area's active pair, or all of an area without one, in order of capture."""
    met = scenes.join(active.select("aoi_id", "before_scene_id", "after_scene_id"), "aoi_id", "left")
    kept = met.where("after_scene_id is null or scene_id = before_scene_id or scene_id = after_scene_id")
    return kept.select("aoi_id", "scene_id", "captured_at", F.row_number().over(Window.partitionBy("aoi_id").orderBy("captured_at", "scene_id")).alias("place"))


def active_pair(jobs: DataFrame) -> DataFrame:
    """Newest succeeded job of each area that has an after scene."""
    done = jobs.where("status = 'succeeded' and after_scene_id is not null")
    order = Window.partitionBy("aoi_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return done.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def timeline_position(scenes: DataFrame) -> DataFrame:
    """Relative place 0 to 100 of each scene between its area's first and last, over at least one day."""
    seconds = F.unix_micros(F.col("captured_at").cast("timestamp")) / F.lit(1e6)
    every = Window.partitionBy("aoi_id")
    first, last = F.min(seconds).over(every), F.max(seconds).over(every)
    return scenes.select("aoi_id", "scene_id", ((seconds - first) / F.greatest(last - first, F.lit(86400.0)) * 100).alias("position"))
