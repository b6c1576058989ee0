"""Table maintenance and detection, job and area queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import placed

from .scenes import active_pair


def upsert_scenes(base: DataFrame, changes: DataFrame, keys=("stac_id", "aoi_id")) -> DataFrame:
    """Base rows updated by key, new keys appended; ``scene_id`` and ``created_at`` stay, ``updated_at`` is the change's.

    Of several changes of one key the latest ``updated_at`` wins; both tables have equal columns.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc("updated_at"), F.desc("scene_id"))
    new = changes.withColumn("place", F.row_number().over(latest)).where("place = 1").drop("place")
    old = base.select(*keys, F.col("scene_id").alias("old_id"), F.col("created_at").alias("old_created"))
    new = new.join(old, list(keys), "left").withColumns({"scene_id": F.coalesce("old_id", "scene_id"), "created_at": F.coalesce("old_created", "created_at")}).select(*base.columns)
    return base.join(new.select(*keys), list(keys), "left_anti").select(*base.columns).unionByName(new)


def upsert_aois(base: DataFrame, changes: DataFrame, protected=("cadence_days", "last_checked_at")) -> DataFrame:
    """Areas by slug: changed columns are taken over, the protected ones never, ids stay."""
    names = [c for c in base.columns if c not in ("slug",)]
    c = changes.select("slug", *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_new"))
    b = base.withColumn("_old", F.lit(True))
    met = b.join(c, "slug", "full_outer")
    pick = lambda n: F.when(F.col("_old") & F.lit(n in (*protected, "aoi_id")), F.col(n)).when(F.col("_new"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n)
    return met.select("slug", *[pick(n) for n in names]).select(*base.columns)


def replace_set(base: DataFrame, rows: DataFrame, run_keys: DataFrame) -> DataFrame:
    """Delete the run's keys from the base and add its rows; a run without rows still clears its keys."""
    keys = run_keys.columns
    return base.join(run_keys.distinct(), keys, "left_anti").select(*base.columns).unionByName(rows.select(*base.columns))


def save_replaced(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows partitioned by their natural key; partitions the rows do not touch stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def delete_cascade(gone: DataFrame, jobs: DataFrame, detections: DataFrame, briefs: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """What is left of the tables after areas are deleted; scenes are not touched."""
    alive = {"jobs": jobs.join(gone, "aoi_id", "left_anti"), "detections": detections.join(gone, "aoi_id", "left_anti"), "briefs": briefs.join(gone, "aoi_id", "left_anti")}
    lost = detections.join(gone, "aoi_id", "left_semi").select("detection_id")
    return alive | {"links": links.join(lost, "detection_id", "left_anti")}


def evidence_constraints(links: DataFrame) -> DataFrame:
    """Links without the id that their type needs."""
    broken = F.when((F.col("evidence_type") == "detection") & F.col("detection_id").isNull(), "detection without id").when((F.col("evidence_type") == "article") & F.col("article_id").isNull(), "article without id")
    return links.withColumn("broken", broken).where("broken is not null")


def query_detections(detections: DataFrame, jobs: DataFrame, scenes: DataFrame, since=None, change_type: str | None = None) -> DataFrame:
    """Detections of each area's active pair, or of all pairs without one, largest first.

    ``since`` is a date; the after scene must be captured from its midnight on.
    """
    pair = active_pair(jobs).select("aoi_id", F.col("before_scene_id").alias("b"), F.col("after_scene_id").alias("a"))
    met = detections.join(pair, "aoi_id", "left").where("a is null or (before_scene_id = b and after_scene_id = a)")
    after = scenes.select(F.col("scene_id").alias("after_scene_id"), "captured_at")
    met = met.join(after, "after_scene_id")
    if since is not None:
        met = met.where(F.col("captured_at") >= F.lit(since).cast("timestamp"))
    if change_type is not None:
        met = met.where(F.col("change_type") == change_type)
    return placed(met.select("aoi_id", "detection_id", "area_m2", "change_type"), ["aoi_id"], [F.desc("area_m2"), F.col("detection_id")])


def detections_for_pair(detections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the given pairs with their place, largest first."""
    keys = ["aoi_id", "before_scene_id", "after_scene_id"]
    met = detections.join(pairs.select(*keys).distinct(), keys, "left_semi")
    return placed(met.select(*keys, "detection_id", "area_m2"), keys, [F.desc("area_m2"), F.col("detection_id")])


def latest_detected_pair(detections: DataFrame) -> DataFrame:
    """Pair of each area's newest detection."""
    newest = F.max_by(F.struct("before_scene_id", "after_scene_id"), F.struct("created_at", "detection_id"))
    return detections.groupBy("aoi_id").agg(newest.alias("p")).select("aoi_id", "p.before_scene_id", "p.after_scene_id")


def rerun_summary(aois: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections, total and largest hectares per area; 0 where there are none."""
    got = detections.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area_m2").alias("total"), F.max("area_m2").alias("largest"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)) / 10000, 4)
    return aois.select("aoi_id").join(got, "aoi_id", "left").select("aoi_id", F.coalesce("n", F.lit(0)).alias("n"), zero("total").alias("total_ha"), zero("largest").alias("largest_ha"))


def change_type_counts(aois: DataFrame, detections: DataFrame) -> DataFrame:
    """Finding text per area: counts by type, most common first, or "No change detected"."""
    counts = detections.groupBy("aoi_id", "change_type").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "change_type", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["change_type"]))
    text = counts.groupBy("aoi_id").agg(F.array_join(parts, ", ").alias("finding"))
    return aois.select("aoi_id").join(text, "aoi_id", "left").select("aoi_id", F.coalesce("finding", F.lit("No change detected")).alias("finding"))


def aoi_order(aois: DataFrame, ranks: DataFrame) -> DataFrame:
    """Areas with their place: showcase rank first, then slug. ``ranks`` has slug and rank."""
    met = aois.join(ranks, "slug", "left").select("aoi_id", "slug", F.coalesce("rank", F.lit(1 << 30)).alias("_rank"))
    return placed(met, [], [F.col("_rank"), F.col("slug")]).drop("_rank")


def is_due(aois: DataFrame, now) -> DataFrame:
    """aoi_id and due: never without cadence, always if never checked, else when the cadence has passed."""
    last = F.col("last_checked_at") + F.make_dt_interval(F.col("cadence_days"))
    due = F.when(F.col("cadence_days").isNull(), False).when(F.col("last_checked_at").isNull(), True).otherwise(last <= F.lit(now).cast("timestamp"))
    return aois.select("*", due.alias("due"))


def recheck_windows(captures: DataFrame, today) -> DataFrame:
    """aoi_id, before_start, after_start, after_end; none where the day after is today or later."""
    day = F.to_date("captured_at")
    return captures.select("aoi_id", day.alias("before_start"), F.date_add(day, 1).alias("after_start"), F.lit(today).cast("date").alias("after_end")).where("after_start < after_end")


def due_rechecks(aois: DataFrame, jobs: DataFrame, scenes: DataFrame, now, today) -> DataFrame:
    """Requests for due areas that have a baseline scene."""
    after = active_pair(jobs).select("aoi_id", F.col("after_scene_id").alias("scene_id")).join(scenes.select("scene_id", "captured_at"), "scene_id")
    return recheck_windows(is_due(aois, now).where("due").select("aoi_id").join(after, "aoi_id"), today)


def zero_detection_audit(aois: DataFrame, detections: DataFrame, jobs: DataFrame) -> DataFrame:
    """Areas without detections: never ran, or ran and found nothing. An area's detections are one row before they are shuffled."""
    silent = aois.select("aoi_id").join(detections.select("aoi_id").distinct(), "aoi_id", "left_anti")
    ran = jobs.where("status = 'succeeded'").select("aoi_id").distinct().withColumn("ran", F.lit(True))
    return silent.join(ran, "aoi_id", "left").select("aoi_id", F.when(F.col("ran"), "ran, found nothing").otherwise("never ran").alias("verdict"))
