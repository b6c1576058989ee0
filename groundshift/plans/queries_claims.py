"""Queries of claim validation and briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.functions import columns as C
from groundshift.operators import claims as V
from groundshift.operators.ranking import PAGE
from groundshift.sources.fixtures import duck, table

from .queries_articles import _CAND, _FUSED, _RANK, _SCORED, _WATCH, _fused
from .registry import query

_MONTHS = "(" + "|".join(C.MONTHS) + ")"
_AREA = r"(\d[\d,]*(?:\.\d+)?)\s*(km²|km2|hectares?|ha|m²|m2|sq\s?m)(?:[^a-zA-Z]|$)"
_MONTH = _MONTHS + r",?\s+(\d{4})"
_QUANT = f"(regexp_matches(text, '{_AREA}', 'i') or regexp_matches(text, '{C.PERCENT}') or regexp_matches(text, '{C.ISO_DATE}') or regexp_matches(text, '{_MONTH}', 'i'))"
_BOTH = "(claim_type = 'mixed' and len(evidence) > 0 and len(article_evidence) > 0)"
_BASE = f"""kd as (select distinct b.brief_id, detection_id id, area_m2 from briefs b join detections d on d.detection_id between b.brief_id and b.brief_id + 3),
ka as (select distinct brief_id, unnest([brief_id % 200, brief_id % 7]::bigint[]) id from briefs),
ok as (select * from claims where trim(text) <> '' and claim_type in ('observed', 'context', 'reported', 'mixed')),
ar as (select brief_id, seq, cast(replace(v, ',', '') as double) * case when lower(u) in ('km²', 'km2') then 1e6 when lower(u) = 'ha' or lower(u) like 'hectare%' then 1e4 else 1.0 end quoted
  from (select brief_id, seq, unnest(regexp_extract_all(text, '{_AREA}', 1, 'i')) v, unnest(regexp_extract_all(text, '{_AREA}', 2, 'i')) u from ok)),
la as (select brief_id, seq, sum(area_m2) linked_area from (select distinct brief_id, seq, unnest(evidence) id from ok where claim_type = 'observed' or {_BOTH}) join kd using (brief_id, id) group by all),
iso as (select brief_id, seq, m, try_cast(concat(split_part(m, '-', 1), '-', lpad(split_part(m, '-', 2), 2, '0'), '-', lpad(split_part(m, '-', 3), 2, '0')) as date) d from (select brief_id, seq, unnest(regexp_extract_all(text, '{C.ISO_DATE}')) m from ok where claim_type = 'observed' or {_BOTH})),
mon as (select brief_id, seq, cast(y as int) * 100 + list_position({[m.lower() for m in C.MONTHS]}, lower(n)) m from (select brief_id, seq, unnest(regexp_extract_all(text, '{_MONTH}', 1, 'i')) n, unnest(regexp_extract_all(text, '{_MONTH}', 2, 'i')) y from ok where claim_type = 'observed' or {_BOTH}))"""
_observed = C.OBSERVED.replace("'", "''")
_V = {
    "structure": """select brief_id, null::int seq, 'empty_brief' code, null::varchar detail from briefs where brief_id not in (select brief_id from claims)
  union all select brief_id, seq, 'blank_claim', null from claims where trim(text) = ''
  union all select brief_id, seq, 'unsupported_claim_type', claim_type from claims where trim(text) <> '' and claim_type not in ('observed', 'context', 'reported', 'mixed')""",
    "linkage": f"""select brief_id, seq, 'unlinked_claim' code, null::varchar detail from ok where claim_type = 'observed' and len(evidence) = 0
  union all select brief_id, seq, 'article_evidence_on_observed_claim', null from ok where claim_type = 'observed' and len(article_evidence) > 0
  union all select brief_id, seq, 'unlinked_reported_claim', null from ok where claim_type = 'reported' and len(article_evidence) = 0
  union all select brief_id, seq, 'mixed_claim_missing_side', null from ok where claim_type = 'mixed' and (len(evidence) = 0 or len(article_evidence) = 0)
  union all select e.brief_id, seq, 'unknown_evidence_id', cast(e.id as varchar) from (select brief_id, seq, unnest(evidence) id from ok where claim_type = 'observed' or {_BOTH}) e where not exists (from kd where kd.brief_id = e.brief_id and kd.id = e.id)
  union all select e.brief_id, seq, 'unknown_article_id', cast(e.id as varchar) from (select brief_id, seq, unnest(article_evidence) id from ok where claim_type in ('reported', 'mixed')) e where not exists (from ka where ka.brief_id = e.brief_id and ka.id = e.id)""",
    "quantity": f"""select brief_id, seq, case claim_type when 'context' then 'quantified_context_claim' else 'quantified_reported_claim' end code, null::varchar detail from ok where claim_type in ('context', 'reported') and {_QUANT}""",
    "framing": f"""select brief_id, seq, 'observational_framing_on_reported_claim' code, null::varchar detail from ok where claim_type = 'reported' and (regexp_matches(text, '{C.OBSERVED}', 'i') or not regexp_matches(text, '{C.REPORTED}', 'i'))""",
    "area": """select brief_id, seq, 'area_mismatch' code, cast(cast(round(quoted, 3) as decimal(20, 3)) as varchar) detail from ar join la using (brief_id, seq) where abs(quoted - linked_area) > 0.1 * linked_area""",
    "date": """select i.brief_id, seq, 'date_mismatch' code, m detail from iso i join briefs b on i.brief_id = b.brief_id where d is null or (d <> before_date and d <> after_date)
  union all select i.brief_id, seq, 'date_mismatch', cast(m as varchar) from mon i join briefs b on i.brief_id = b.brief_id where m <> year(before_date) * 100 + month(before_date) and m <> year(after_date) * 100 + month(after_date)""",
}
_ALL = "viol as (" + " union all ".join(_V.values()) + ")"
_TABLES = ("claims", "briefs", "detections")


def _sql(kind):
    return duck(_V[kind], *_TABLES, extra=_BASE)


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "claims")


def _briefs(spark, sf_dir):
    """Briefs of the fixture, and among them some without any claim."""
    return table(spark, sf_dir, "briefs")


def _known(spark, sf_dir):
    b = table(spark, sf_dir, "briefs").select("brief_id")
    d = table(spark, sf_dir, "detections").select(F.col("detection_id").alias("id"), "area_m2")
    detections = b.withColumn("id", F.explode(F.sequence("brief_id", F.col("brief_id") + 3))).join(d, "id")
    articles = b.select("brief_id", F.explode(F.array(F.col("brief_id") % 200, F.col("brief_id") % 7)).alias("id")).distinct()
    return detections.select("brief_id", "id", "area_m2"), articles


def _violations(spark, sf_dir):
    return V.validate_briefs(_claims(spark, sf_dir), _briefs(spark, sf_dir), *_known(spark, sf_dir))


@query("select conv_id brief_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) seq, text, role from conversations")
def claims_exploded(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    drafts = c.groupBy(F.col("conv_id").alias("brief_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("claims"))
    return V.claims_exploded(drafts).select("brief_id", "seq", "text", "role")


@query(duck("select brief_id, seq, quoted from ar", *_TABLES, extra=_BASE))
def area_mentions(spark, sf_dir):
    rows = _claims(spark, sf_dir).where("trim(text) <> '' and claim_type <> 'rumour'")
    return rows.select("brief_id", "seq", F.explode(C.area_mentions(F.col("text"))).alias("quoted"))


@query(duck("select brief_id, seq, m mention, d \"day\" from iso union all select brief_id, seq, cast(m as varchar), null from mon", *_TABLES, extra=_BASE))
def date_mentions(spark, sf_dir):
    rows = _claims(spark, sf_dir).where("trim(text) <> '' and (claim_type = 'observed' or (claim_type = 'mixed' and size(evidence) > 0 and size(article_evidence) > 0))")
    iso = rows.select("brief_id", "seq", F.explode(C.iso_mentions(F.col("text"))).alias("mention")).withColumn("day", C.iso_date(F.col("mention")))
    months = rows.select("brief_id", "seq", F.explode(C.month_mentions(F.col("text"))).alias("mention")).select("brief_id", "seq", F.col("mention").cast("string").alias("mention"), F.lit(None).cast("date").alias("day"))
    return iso.unionByName(months)


@query(duck(f"select brief_id, seq, {_QUANT} quantity from claims", "claims"))
def has_quantity(spark, sf_dir):
    return _claims(spark, sf_dir).select("brief_id", "seq", C.has_quantity(F.col("text")).alias("quantity"))


@query(_sql("structure"))
def structure_violations(spark, sf_dir):
    return V.structure_violations(_claims(spark, sf_dir), _briefs(spark, sf_dir))


@query(_sql("linkage"))
def linkage_violations(spark, sf_dir):
    return V.linkage_violations(_claims(spark, sf_dir), *_known(spark, sf_dir))


@query(_sql("quantity"))
def quantity_violations(spark, sf_dir):
    return V.quantity_violations(_claims(spark, sf_dir))


@query(_sql("framing"))
def framing_violations(spark, sf_dir):
    return V.framing_violations(_claims(spark, sf_dir))


@query(_sql("area"))
def area_violations(spark, sf_dir):
    return V.area_violations(_claims(spark, sf_dir), _known(spark, sf_dir)[0])


@query(_sql("date"))
def date_violations(spark, sf_dir):
    return V.date_violations(_claims(spark, sf_dir), _briefs(spark, sf_dir))


@query(duck("select * from viol", *_TABLES, extra=_BASE + ", " + _ALL))
def validate_briefs(spark, sf_dir):
    return _violations(spark, sf_dir)


@query(duck("""select g group_id, case when max(won) is not null then 'validated' else 'rejected' end status, cast(coalesce(max(won), max(made)) as bigint) attempts, cast(sum(tokens) as bigint) tokens from
  (select *, min(case when clean then attempt end) over (partition by g) won, max(attempt) over (partition by g) made from
    (select brief_id // 4 g, brief_id % 4 + 1 attempt, brief_id * 3 + 1 tokens, brief_id not in (select brief_id from viol) clean from briefs where brief_id % 4 + 1 <= 3)) where attempt <= coalesce(won, made) group by g""", *_TABLES, extra=_BASE + ", " + _ALL))
def resolve_attempts(spark, sf_dir):
    attempts = _briefs(spark, sf_dir).selectExpr("brief_id", "brief_id div 4 group_id", "brief_id % 4 + 1 attempt", "brief_id * 3 + 1 tokens")
    return V.resolve_attempts(attempts, _violations(spark, sf_dir))


_CONTEXT = """dctx as (select * from (select aoi_id, before_scene_id, after_scene_id, count(*) n, round(sum(area_m2), 2) total_area from detections group by all)
  join (select aoi_id, before_scene_id, after_scene_id, string_agg(concat(change_type, '=', cast(k as varchar)), ', ' order by change_type) by_type from (select aoi_id, before_scene_id, after_scene_id, change_type, count(*) k from detections group by all) group by all) using (aoi_id, before_scene_id, after_scene_id)
  join (select aoi_id, before_scene_id, after_scene_id, string_agg(concat('id=', cast(detection_id as varchar), ' type=', change_type, ' area_m2=', cast(cast(round(area_m2) as bigint) as varchar), ' magnitude=', cast(cast(round(magnitude * 1000) as bigint) // 1000 as varchar), '.', lpad(cast(cast(round(magnitude * 1000) as bigint) % 1000 as varchar), 3, '0'),
  ' confidence=', cast(cast(round(confidence * 100) as bigint) // 100 as varchar), '.', lpad(cast(cast(round(confidence * 100) as bigint) % 100 as varchar), 2, '0')), chr(10) order by rn) lines
    from (select *, row_number() over (partition by aoi_id, before_scene_id, after_scene_id order by area_m2 desc, detection_id) rn from detections) where rn <= 50 group by all) using (aoi_id, before_scene_id, after_scene_id)),
actx as (select aoi_id, count(*) n_articles, string_agg(concat('[', cast(article_id as varchar), '] ', strftime(seendate, '%Y-%m-%dT%H:%M:%S'), ' ', "domain", ': ', title), chr(10) order by rn2) filter (rn2 <= 10) article_lines
  from (select *, row_number() over (partition by aoi_id order by seendate, article_id) rn2 from fused) group by aoi_id)"""


@query(duck("""select brief_id, coalesce(n, 0) n, coalesce(total_area, 0) total_area, coalesce(by_type, '') by_type, coalesce(lines, '') lines, coalesce(n_articles, 0) n_articles, coalesce(article_lines, '') article_lines
  from briefs b left join dctx d on b.aoi_id = d.aoi_id and b.before_scene_id = d.before_scene_id and b.after_scene_id = d.after_scene_id left join actx a on a.aoi_id = b.aoi_id""", "briefs", "detections", "articles", extra=", ".join((_WATCH, _SCORED, _CAND, _RANK, _FUSED, _CONTEXT))))
def brief_context(spark, sf_dir):
    return V.brief_context(_briefs(spark, sf_dir), table(spark, sf_dir, "detections"), _fused(spark, sf_dir))


_LINKS = """lk as (select brief_id, seq, 'detection' evidence_type, unnest(evidence) detection_id, null::bigint article_id from claims where brief_id in (select brief_id from briefs where status = 'validated')
  union all select brief_id, seq, 'article', null, unnest(article_evidence) from claims where brief_id in (select brief_id from briefs where status = 'validated'))"""


@query(duck("select * from lk", "claims", "briefs", extra=_LINKS))
def persist_claims(spark, sf_dir):
    return V.persist_claims(_claims(spark, sf_dir), _briefs(spark, sf_dir))


@query(duck("select brief_id, case when status = 'validated' and exists (from detections d where d.aoi_id = b.aoi_id and d.before_scene_id = b.before_scene_id and d.after_scene_id = b.after_scene_id and d.area_m2 > 480000) then 'stale' else status end status from briefs b", "briefs", "detections"))
def stale_briefs(spark, sf_dir):
    return V.stale_briefs(_briefs(spark, sf_dir), table(spark, sf_dir, "detections").where("area_m2 > 480000")).select("brief_id", "status")


@query(duck("select aoi_id, arg_max(brief_id, (created_at, brief_id)) brief_id from briefs where status = 'validated' group by aoi_id", "briefs"))
def latest_validated_brief(spark, sf_dir):
    return V.latest_validated_brief(_briefs(spark, sf_dir)).select("aoi_id", "brief_id")


@query(duck(f"""select c.brief_id, c.seq, cast(coalesce(page, 0) as int) page, claim_type, coalesce(array_to_string(l[1 + page * {PAGE}:(page + 1) * {PAGE}], ' '), '') links from claims c left join (select *, unnest(range(0, cast(ceil(len(l) / {PAGE}.0) as bigint))) page from
  (select brief_id, seq, list(concat(evidence_type, ':', cast(coalesce(detection_id, article_id) as varchar)) order by concat(evidence_type, ':', cast(coalesce(detection_id, article_id) as varchar))) l from lk group by all)) n on c.brief_id = n.brief_id and c.seq = n.seq
  where c.brief_id in (select brief_id from briefs where status in ('validated', 'stale'))""", "claims", "briefs", extra=_LINKS))
def claims_with_evidence(spark, sf_dir):
    c, b = _claims(spark, sf_dir), _briefs(spark, sf_dir)
    return V.claims_with_evidence(c, b, V.persist_claims(c, b)).withColumn("links", F.array_join("links", " "))
