"""Queries over whole tables in which some rows have no partner: those are added on the other side, none is taken away."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.operators import claims as V
from groundshift.operators import geometry as M
from groundshift.operators import regions as G
from groundshift.operators import scenes as S
from groundshift.operators import scoring as K
from groundshift.operators import store as T
from groundshift.operators.ranking import PAGE
from groundshift.sources.fixtures import duck, read, table

from .queries_regions import LABELS, _labels
from .queries_scenes import ACTIVE
from .queries_scoring import _RATIO, _rounded
from .registry import query

#: All areas, and as many again that have no detections; of those the ones below 115 have run.
_AREAS = "areas as (select aoi_id from aois union all select aoi_id + 100 from aois), runs as (select aoi_id, status from jobs union all select aoi_id + 100, 'succeeded' from aois where aoi_id < 15)"


def _areas(spark, sf_dir):
    a = table(spark, sf_dir, "aois")
    return a.select("aoi_id").unionByName(a.select((F.col("aoi_id") + 100).alias("aoi_id")))


@query(duck("select a.aoi_id, count(d.area_m2) n, round(coalesce(sum(cast(round(area_m2 * 100) as bigint)) / 1000000.0::double, 0), 4) total_ha, round(coalesce(max(area_m2) / 10000, 0), 4) largest_ha from areas a left join detections d on a.aoi_id = d.aoi_id group by a.aoi_id", "aois", "detections", "jobs", extra=_AREAS))
def rerun_summary(spark, sf_dir):
    return T.rerun_summary(_areas(spark, sf_dir), table(spark, sf_dir, "detections"))


@query(duck("""select a.aoi_id, coalesce(f, 'No change detected') finding from areas a left join (select aoi_id, string_agg(concat(cast(n as varchar), ' ', change_type), ', ' order by n desc, change_type) f
  from (select aoi_id, change_type, count(*) n from detections group by all) group by aoi_id) c on a.aoi_id = c.aoi_id""", "aois", "detections", "jobs", extra=_AREAS))
def change_type_counts(spark, sf_dir):
    return T.change_type_counts(_areas(spark, sf_dir), table(spark, sf_dir, "detections"))


@query(duck("select aoi_id, case when aoi_id in (select aoi_id from runs where status = 'succeeded') then 'ran, found nothing' else 'never ran' end verdict from areas where aoi_id not in (select aoi_id from detections)", "aois", "detections", "jobs", extra=_AREAS))
def zero_detection_audit(spark, sf_dir):
    runs = table(spark, sf_dir, "jobs").select("aoi_id", "status").unionByName(table(spark, sf_dir, "aois").where("aoi_id < 15").selectExpr("aoi_id + 100 aoi_id", "'succeeded' status"))
    return T.zero_detection_audit(_areas(spark, sf_dir), table(spark, sf_dir, "detections"), runs)


@query(duck("""select d.aoi_id, detection_id, area_m2, change_type, cast(row_number() over (partition by d.aoi_id order by area_m2 desc, detection_id) as int) place from detections d left join act p on d.aoi_id = p.aoi_id
  join scenes s on s.scene_id = d.after_scene_id where (p.after_scene_id is null or (d.before_scene_id = p.before_scene_id and d.after_scene_id = p.after_scene_id)) and s.captured_at >= timestamp '2024-01-01' and change_type = 'flooding'""", "detections", "jobs", "scenes", extra=ACTIVE))
def query_detections(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return T.query_detections(t("detections"), t("jobs"), t("scenes"), "2024-01-01", "flooding")


@query(duck("""select spec_id, q.stac_id, q."day", case when u is null then 'missing' when u < 0.7 then 'below usable minimum' else 'found' end status from
  (select scene_id spec_id, stac_id, cast(captured_at as date) "day" from scenes union all select -scene_id, concat(stac_id, 'x'), cast(captured_at as date) from scenes) q
  left join (select stac_id, cast(captured_at as date) "day", max(usable_fraction) u from scenes group by all) n on q.stac_id = n.stac_id and q."day" = n."day" """, "scenes"))
def pin_scene(spark, sf_dir):
    s = table(spark, sf_dir, "scenes")
    there = s.selectExpr("scene_id spec_id", "stac_id", "to_date(captured_at) day")
    return S.pin_scene(there.unionByName(s.selectExpr("-scene_id spec_id", "concat(stac_id, 'x') stac_id", "to_date(captured_at) day")), s)


@query(duck("select aoi_id, min(l.row) min_row, min(l.col) min_col, max(l.row) + 1 max_row, max(l.col) + 1 max_col from lab l group by aoi_id", "pixels", extra=LABELS))
def region_bounds(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return M.region_bounds(G.region_outline(labels), labels.select("aoi_id", "region_id").distinct())


@query(duck(f"select o_custkey, tp, fp, fn, {_RATIO} from c", extra="""c as (select o_custkey, count(*) filter (o_orderstatus = 'F') tp, count(*) filter (o_orderstatus = 'O') fp, count(*) filter (o_orderstatus = 'P') fn from orders group by all
  union all select -c_custkey, 0, 0, 0 from customer)"""))
def score_ratios(spark, sf_dir):
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "tp"), ("O", "fp"), ("P", "fn"))])
    none = read(spark, sf_dir, "customer").selectExpr("-c_custkey o_custkey", "0L tp", "0L fp", "0L fn")
    return _rounded(K.score_ratios(counts.unionByName(none)))


@query("""with s as (select c_name metric, c_acctbal "value" from customer union all select concat('old ', c_name), c_acctbal from customer), f as (select c_name metric, c_acctbal + c_custkey % 3 "value" from customer union all select concat('new ', c_name), c_acctbal from customer)
select coalesce(s.metric, f.metric) metric, s."value" stored, f."value" fresh, round(abs(s."value" - f."value"), 6) drift from s full join f on s.metric = f.metric""")
def run_drift(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    side = lambda value, other: c.selectExpr("c_name metric", f"{value} value").unionByName(c.selectExpr(f"concat('{other} ', c_name) metric", "c_acctbal value"))
    return K.run_drift(side("c_acctbal", "old"), side("c_acctbal + c_custkey % 3", "new")).withColumn("drift", F.round("drift", 6))


_PAIRS = "every as (select claim_id, detection_id from links union all select claim_id + 10000000, -1 - detection_id from links)"


@query(duck(f"""select kind, id, cast(page as int) page, array_to_string(o[1 + page * {PAGE}:(page + 1) * {PAGE}], ' ') others from (select *, unnest(range(0, greatest(1, cast(ceil(len(o) / {PAGE}.0) as bigint)))) page from (
  select 'claim' kind, claim_id id, coalesce(list(detection_id order by detection_id) filter (detection_id is not null), []) o from (select distinct l.claim_id, d.detection_id from every l left join detections d on l.detection_id = d.detection_id) group by claim_id
  union all select 'detection', detection_id, list(claim_id order by claim_id) from (select distinct claim_id, detection_id from every where detection_id in (select detection_id from detections)) group by detection_id))""", "links", "detections", extra=_PAIRS))
def evidence_index(spark, sf_dir):
    links = table(spark, sf_dir, "links").select("claim_id", "detection_id")
    by_claim, by_detection = V.evidence_index(links.unionByName(links.selectExpr("claim_id + 10000000 claim_id", "-1 - detection_id detection_id")), table(spark, sf_dir, "detections"))
    a = by_claim.select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), "page", F.array_join("detections", " ").alias("others"))
    return a.union(by_detection.select(F.lit("detection"), "detection_id", "page", F.array_join("claims", " ")))
