"""Queries of table maintenance, detections, jobs and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.operators import store as T
from groundshift.sources import readers as R
from groundshift.sources.fixtures import duck, read, table

from .queries_scenes import ACTIVE
from .registry import query

NOW, TODAY = "2024-01-27 12:00:00", "2024-01-28"


def _base(spark, sf_dir):
    s = table(spark, sf_dir, "scenes").groupBy("stac_id", "aoi_id").agg(F.min("scene_id").alias("scene_id"), F.min("captured_at").alias("created_at"), F.max("cloud_pct").alias("cloud_pct"))
    return s.select("scene_id", "stac_id", "aoi_id", "cloud_pct", F.col("created_at").cast("timestamp").alias("created_at"), F.col("created_at").cast("timestamp").alias("updated_at"))


def _changes(spark, sf_dir):
    s = table(spark, sf_dir, "scenes").where("scene_id % 3 = 0")
    return s.selectExpr("scene_id + 1000000 scene_id", "case when scene_id % 2 = 0 then stac_id else concat(stac_id, 'n') end stac_id", "aoi_id", "cloud_pct / 2 cloud_pct", "cast(captured_at as timestamp) + interval 1 day created_at", "cast(captured_at as timestamp) + interval 1 day updated_at")


@query(duck("""select coalesce(b.scene_id, c.scene_id) scene_id, coalesce(b.stac_id, c.stac_id) stac_id, coalesce(b.aoi_id, c.aoi_id) aoi_id, coalesce(c.cloud_pct, b.cloud_pct) cloud_pct, coalesce(b.created_at, c.created_at) created_at,
  coalesce(c.updated_at, b.updated_at) updated_at from b full join c on b.stac_id = c.stac_id and b.aoi_id = c.aoi_id""", "scenes", extra="""b as (select stac_id, aoi_id, min(scene_id) scene_id, min(captured_at) created_at, min(captured_at) updated_at, max(cloud_pct) cloud_pct from scenes group by all),
c as (select * from (select *, row_number() over (partition by stac_id, aoi_id order by updated_at desc, scene_id desc) rn from (select scene_id + 1000000 scene_id, case when scene_id % 2 = 0 then stac_id else concat(stac_id, 'n') end stac_id, aoi_id, cloud_pct / 2 cloud_pct,
  captured_at + to_days(1) created_at, captured_at + to_days(1) updated_at from scenes where scene_id % 3 = 0)) where rn = 1)"""))
def upsert_scenes(spark, sf_dir):
    return T.upsert_scenes(_base(spark, sf_dir), _changes(spark, sf_dir))


@query("""with b as (select c_custkey aoi_id, c_name slug, c_mktsegment segment, case when c_custkey % 4 <> 0 then 7 end cadence_days, c_acctbal last_checked_at from customer),
c as (select c_custkey + 100000 aoi_id, case when c_custkey % 2 = 0 then c_name else concat('new ', c_name) end slug, 'NEW' segment, 1 cadence_days, 0.0::double last_checked_at from customer)
select coalesce(b.aoi_id, c.aoi_id) aoi_id, coalesce(b.slug, c.slug) slug, coalesce(c.segment, b.segment) segment, case when b.slug is not null then b.cadence_days else c.cadence_days end cadence_days,
  case when b.slug is not null then b.last_checked_at else c.last_checked_at end last_checked_at from b full join c on b.slug = c.slug""")
def upsert_aois(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    base = c.selectExpr("c_custkey aoi_id", "c_name slug", "c_mktsegment segment", "case when c_custkey % 4 <> 0 then 7 end cadence_days", "c_acctbal last_checked_at")
    return T.upsert_aois(base, c.selectExpr("c_custkey + 100000 aoi_id", "case when c_custkey % 2 = 0 then c_name else concat('new ', c_name) end slug", "'NEW' segment", "1 cadence_days", "0.0D last_checked_at"))


@query(duck("""select detection_id, aoi_id, before_scene_id, after_scene_id, area_m2 from detections where not (aoi_id % 3 = 0 and before_scene_id = 2 and after_scene_id = 3)
  union all select detection_id + 10000000, aoi_id, before_scene_id, after_scene_id, area_m2 / 2 from detections where aoi_id % 6 = 0 and before_scene_id = 2 and after_scene_id = 3""", "detections"))
def replace_set(spark, sf_dir):
    d = table(spark, sf_dir, "detections").select("detection_id", "aoi_id", "before_scene_id", "after_scene_id", "area_m2")
    mine = "before_scene_id = 2 and after_scene_id = 3"
    rows = d.where(f"aoi_id % 6 = 0 and {mine}").withColumns({"detection_id": F.col("detection_id") + 10000000, "area_m2": F.col("area_m2") / 2})
    keys = d.where(f"aoi_id % 3 = 0 and {mine}").select("aoi_id", "before_scene_id", "after_scene_id")
    return T.replace_set(d, rows, keys)


@query(duck("""select 'jobs' "table", count(*) n from jobs where aoi_id not in (1, 4) union all select 'detections', count(*) from detections where aoi_id not in (1, 4)
  union all select 'briefs', count(*) from briefs where aoi_id not in (1, 4) union all select 'links', count(*) from links where detection_id is null or detection_id not in (select detection_id from detections where aoi_id in (1, 4))""", "jobs", "detections", "briefs", "links"))
def delete_cascade(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    left = T.delete_cascade(t("aois").where("aoi_id in (1, 4)").select("aoi_id"), t("jobs"), t("detections"), t("briefs"), t("links"))
    out = None
    for name, df in left.items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


@query(duck("""select claim_id, evidence_type, detection_id, article_id, case when evidence_type = 'detection' then 'detection without id' else 'article without id' end broken from links
  where (evidence_type = 'detection' and detection_id is null) or (evidence_type = 'article' and article_id is null)""", "links"))
def evidence_constraints(spark, sf_dir):
    return T.evidence_constraints(table(spark, sf_dir, "links"))


@query("""select concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[', cast(c_custkey as varchar), ',0],[', cast(c_custkey + 1 as varchar), ',0],[', cast(c_custkey as varchar), ',1],[', cast(c_custkey as varchar), ',0]]]},"properties":{"c_name":"', c_name, '","c_nationkey":', cast(c_nationkey as varchar), '}}') feature from customer""")
def geojson_features(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    at = lambda dx, y: F.array(F.col("k") + dx, F.lit(y).cast("long"))
    return R.geojson_features(c, F.array(F.array(at(0, 0), at(1, 0), at(0, 1), at(0, 0))), ["c_name", "c_nationkey"])


@query(duck("""select aoi_id, before_scene_id, after_scene_id, detection_id, area_m2, cast(row_number() over (partition by aoi_id, before_scene_id, after_scene_id order by area_m2 desc, detection_id) as int) place
  from detections d where exists (from briefs b where b.aoi_id = d.aoi_id and b.before_scene_id = d.before_scene_id and b.after_scene_id = d.after_scene_id)""", "detections", "briefs"))
def detections_for_pair(spark, sf_dir):
    return T.detections_for_pair(table(spark, sf_dir, "detections"), table(spark, sf_dir, "briefs"))


@query(duck("select aoi_id, arg_max(before_scene_id, (created_at, detection_id)) before_scene_id, arg_max(after_scene_id, (created_at, detection_id)) after_scene_id from detections group by aoi_id", "detections"))
def latest_detected_pair(spark, sf_dir):
    return T.latest_detected_pair(table(spark, sf_dir, "detections"))


@query(duck("select aoi_id, slug, cast(row_number() over (order by case when aoi_id % 10 = 7 then aoi_id else 1073741824 end, slug) as int) place from aois", "aois"))
def aoi_order(spark, sf_dir):
    a = table(spark, sf_dir, "aois")
    return T.aoi_order(a, a.where("aoi_id % 10 = 7").selectExpr("slug", "aoi_id rank"))


@query(duck(f"select aoi_id, case when cadence_days is null then false when last_checked_at is null then true else last_checked_at + to_days(cadence_days) <= timestamp '{NOW}' end due from aois", "aois"))
def is_due(spark, sf_dir):
    return T.is_due(table(spark, sf_dir, "aois"), NOW).select("aoi_id", "due")


_WINDOWS = "select aoi_id, cast(captured_at as date) before_start, cast(captured_at as date) + 1 after_start, date '{t}' after_end from {s} where cast(captured_at as date) + 1 < date '{t}'"


@query(duck(_WINDOWS.format(t=TODAY, s="scenes"), "scenes"))
def recheck_windows(spark, sf_dir):
    return T.recheck_windows(table(spark, sf_dir, "scenes"), TODAY)


@query(duck(_WINDOWS.format(t="2024-02-15", s="base"), "aois", "jobs", "scenes", extra=ACTIVE + f""", base as (select a.aoi_id, s.captured_at from aois a join act j on a.aoi_id = j.aoi_id join scenes s on s.scene_id = j.after_scene_id
  where cadence_days is not null and (last_checked_at is null or last_checked_at + to_days(cadence_days) <= timestamp '{NOW}'))"""))
def due_rechecks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return T.due_rechecks(t("aois"), t("jobs"), t("scenes"), NOW, "2024-02-15")
