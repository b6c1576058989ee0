"""Adapters from the given TPC-like tables to the engine's own table shapes.

Each adapter is a DataFrame function and, in ``SQL``, the same table as a DuckDB query, so that an
operator and its SQL check start from equal rows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

#: Digital numbers of land covers: red, green, blue, nir (fixed values of the test scenes).
COVERS = {"forest": (400, 600, 300, 3500), "bare": (2200, 1900, 1500, 2600), "water": (300, 500, 600, 150), "built": (2600, 2400, 2200, 2300)}
BANDS = ("red", "green", "blue", "nir")
#: Cover before and after a change in areas of vertical 0 port, 1 forest, 2 flood.
CHANGES = (("water", "built"), ("forest", "bare"), ("bare", "water"))
SIDE = 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _band_sql(band: str) -> tuple[str, str]:
    i = BANDS.index(band)
    before = "case vertical " + " ".join(f"when {v} then {COVERS[a][i]}" for v, (a, _) in enumerate(CHANGES)) + " end"
    after = "case vertical " + " ".join(f"when {v} then {COVERS[b][i]}" for v, (_, b) in enumerate(CHANGES)) + " end"
    return f"cast({before} + n0 as int) as {band}0", f"cast(case when changed then {after} else {before} end + n1 as int) as {band}1"


def _pixels_sql(div: str) -> str:
    bands = [_band_sql(b) for b in BANDS]
    return f"""
select aoi_id, row, col, vertical, scl, {', '.join(b[0] for b in bands)}, {', '.join(b[1] for b in bands)} from (
  select *, cast(aoi_id % 3 as int) vertical, cast(case when col >= 45 and k % 7 = 0 then 9 else 4 end as int) scl,
    (row >= 10 and row < 20 and col >= 5 and col < 25) or (row >= 30 and row < 34 and col >= 35 and col < 39) changed
  from (select o_orderkey k, cast(o_orderkey {div} 2500 as int) aoi_id, cast((o_orderkey % 2500) {div} 50 as int) row, cast(o_orderkey % 50 as int) col,
    cast(round(o_totalprice * 100) as bigint) % 81 - 40 n0, (o_custkey * 37) % 81 - 40 n1 from orders))
"""


_SCENES = """
select event_id scene_id, cast(user_id % 12 as int) aoi_id, ts captured_at, round({least}, 6) cloud_pct,
  round(1 - cast({k} as int) / {hundred}, 6) usable_fraction, cast(32600 + user_id % 60 + 1 as int) epsg,
  concat('S2A_', lpad(cast(user_id % 60 + 1 as {text}), 2, '0'), 'JDM_', {ymd}, '_', cast(event_id % 3 as {text}), '_L2A') stac_id,
  case event_id % 4 when 0 then '02.14' when 1 then '04.00' when 2 then '05.11' else 'bad' end baseline, event_id % 2 = 0 offset_applied
from events
"""
SCENES_SPARK = _SCENES.format(least="least(100.0D, value / 4)", k="get_json_object(props, '$.k')", hundred="100.0D", text="string", ymd="date_format(ts, 'yyyyMMdd')")
SCENES_DUCK = _SCENES.format(least="least(100.0::double, value / 4)", k="json_extract_string(props, '$.k')", hundred="100.0::double", text="varchar", ymd="strftime(ts, '%Y%m%d')")

_JOBS = """
select event_id job_id, cast(user_id % 12 as int) aoi_id,
  case event_type when 'purchase' then 'succeeded' when 'error' then 'failed' when 'signup' then 'queued' else 'running' end status, ts created_at,
  lag(event_id) over (partition by user_id % 12 order by ts, event_id) before_scene_id,
  case when lag(event_id) over (partition by user_id % 12 order by ts, event_id) is not null then event_id end after_scene_id
from events
"""

_AOIS = """
select n_nationkey aoi_id, lower(n_name) slug, cast(n_nationkey % 3 as int) vertical,
  cast(-60 + 3 * n_nationkey as double) minx, cast(-20 + 2 * n_nationkey as double) miny, -60 + 3 * n_nationkey + {d} maxx, -20 + 2 * n_nationkey + {d} maxy,
  case when n_nationkey % 4 <> 0 then 7 end cadence_days,
  case when n_nationkey % 5 <> 0 then {ts} end last_checked_at,
  case when n_nationkey % 6 = 0 then {empty} when n_nationkey % 2 = 0 then {a} else {b} end place_terms
from nation
"""
AOIS_SPARK = _AOIS.format(d="0.04D", ts="timestamp'2024-01-20 00:00:00' + make_dt_interval(cast(n_nationkey % 9 as int))", empty="cast(array() as array<string>)", a="array('The', 'And')", b="array('Für', 'Que')")
AOIS_DUCK = _AOIS.format(d="0.04::double", ts="timestamp '2024-01-20 00:00:00' + to_days(cast(n_nationkey % 9 as int))", empty="[]::varchar[]", a="['The', 'And']", b="['Für', 'Que']")

_DETECTIONS = """
select o_orderkey detection_id, cast(o_custkey % 25 as int) aoi_id, o_totalprice area_m2, o_orderdate created_at,
  case o_orderkey % 3 when 0 then 'construction' when 1 then 'vegetation_loss' else 'flooding' end change_type,
  o_custkey % 7 before_scene_id, o_custkey % 7 + 1 + o_orderkey % 2 after_scene_id,
  round(o_totalprice / 1000000, 6) magnitude, round(o_custkey % 100 / {hundred}, 6) confidence
from orders
"""

_LINKS = """
select l_partkey claim_id, case when l_returnflag = 'A' then 'detection' when l_returnflag = 'N' then 'article' else 'mixed' end evidence_type,
  case when l_returnflag <> 'N' or l_linenumber = 2 then l_orderkey end detection_id, case when l_returnflag <> 'A' and l_linenumber <> 3 then l_suppkey end article_id
from lineitem
"""

_ARTICLES = """
select doc_id article_id, {first} title, source domain,
  case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' when 'es' then 'Spanish' else lang end language,
  concat(case when doc_id % 17 = 0 then 'ftp://' else 'https://' end, source, '/', cast(doc_id as {text})) url,
  {seen} seendate, text full_text
from documents
"""
ARTICLES_SPARK = _ARTICLES.format(first="split_part(text, '.', 1)", text="string", seen="cast(date_add(date'2023-06-01', cast(doc_id % 500 as int)) as timestamp)")
ARTICLES_DUCK = _ARTICLES.format(first="split_part(text, '.', 1)", text="varchar", seen="cast(date '2023-06-01' + cast(doc_id % 500 as int) as timestamp)")

#: Suffixes that give claims their figures, by (conv_id * 7 + turn) % 8.
SUFFIXES = (" about 12,500 m²", " 1.25 ha and 40%", " on 2024-1-3", " on 2024-13-45 or 2024-01-05", " in January, 2024", " regional news reports it", " imagery shows it", "")
_CLAIMS = """
select conv_id brief_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) seq,
  case when (conv_id + turn) % 5 = 0 then 'mixed' when role = 'user' then 'observed' when role = 'assistant' then 'reported' when conv_id % 9 = 0 then 'rumour' else 'context' end claim_type,
  case when conv_id % 23 = 0 and turn = 1 then '  ' else concat(text, case (conv_id * 7 + turn) % 8 {cases} end) end text,
  case when turn % 4 = 3 then {empty} when turn % 6 = 5 then {unknown} else {known} end evidence,
  case when turn % 4 = 1 then {empty} when turn % 7 = 4 then {unknown} else {articles} end article_evidence
from conversations
"""
_cases = " ".join(f"when {i} then '{s}'" for i, s in enumerate(SUFFIXES))
CLAIMS_SPARK = _CLAIMS.format(cases=_cases, empty="cast(array() as array<bigint>)", unknown="array(conv_id, -1L, conv_id)", known="array(conv_id, conv_id + 1)", articles="array(conv_id % 200)")
CLAIMS_DUCK = _CLAIMS.format(cases=_cases, empty="[]::bigint[]", unknown="[conv_id, -1, conv_id]::bigint[]", known="[conv_id, conv_id + 1]::bigint[]", articles="[conv_id % 200]::bigint[]")

_BRIEFS = """
select distinct conv_id brief_id, cast(conv_id % 25 as int) aoi_id, conv_id % 7 before_scene_id, conv_id % 7 + 1 after_scene_id,
  case when conv_id % 4 = 3 then 'rejected' else 'validated' end status, {before} before_date, {after} after_date, {created} created_at
from conversations
"""
BRIEFS_SPARK = _BRIEFS.format(before="date'2024-01-03'", after="date_add(date'2024-01-05', cast(conv_id % 3 as int))", created="timestamp'2024-02-01 00:00:00' + make_dt_interval(cast(conv_id % 11 as int))")
BRIEFS_DUCK = _BRIEFS.format(before="date '2024-01-03'", after="cast(date '2024-01-05' + cast(conv_id % 3 as int) as date)", created="timestamp '2024-02-01 00:00:00' + to_days(cast(conv_id % 11 as int))")

#: name: (base tables, Spark SQL, DuckDB SQL)
TABLES = {
    "pixels": (["orders"], _pixels_sql("div"), _pixels_sql("//")),
    "scenes": (["events"], SCENES_SPARK, SCENES_DUCK),
    "jobs": (["events"], _JOBS, _JOBS),
    "aois": (["nation"], AOIS_SPARK, AOIS_DUCK),
    "detections": (["orders"], _DETECTIONS.format(hundred="100.0D"), _DETECTIONS.format(hundred="100.0::double")),
    "links": (["lineitem"], _LINKS, _LINKS),
    "articles": (["documents"], ARTICLES_SPARK, ARTICLES_DUCK),
    "claims": (["conversations"], CLAIMS_SPARK, CLAIMS_DUCK),
    "briefs": (["conversations"], BRIEFS_SPARK, BRIEFS_DUCK),
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``TABLES`` over the tables in ``sf_dir``."""
    bases, query, _ = TABLES[name]
    return spark.sql(query.replace(f"from {bases[0]}", "from {base}"), base=read(spark, sf_dir, bases[0]))


def duck(body: str, *names: str, extra: str = "") -> str:
    """DuckDB SQL of ``body`` over the named adapters as common table expressions."""
    parts = [f"{n} as ({TABLES[n][2]})" for n in names]
    if extra:
        parts.append(extra)
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body
