"""Queries of article correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.functions import columns as C
from groundshift.operators import articles as A
from groundshift.operators.ranking import PAGE
from groundshift.sources.fixtures import duck, read, table

from .registry import query

#: Watches over the article fixture: aoi, place terms, region terms, stems, languages, days of before and after.
WATCHES = (
    (0, ["The", "And"], [], ["est", "ing", "ha"], ["English"], "2023-08-31", "2024-06-16"),
    (1, ["Für", "Que"], ["und"], ["er", "ci"], ["German", "Spanish"], "2023-02-01", "2024-07-01"),
    (2, [], [], ["ha"], ["English"], "2023-08-31", "2024-06-16"),
)
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
_WATCH = "w0 as (" + " union all ".join(f"select {a} aoi_id, {_list(p)} place_terms, {_list(r)} region_terms, {_list(s)} stems, {_list(g)} languages, timestamp '{b}' before_at, timestamp '{c}' after_at" for a, p, r, s, g, b, c in WATCHES) + """),
watches as (select *, greatest(before_at, after_at - to_days(400)) - to_days(30) window_start, after_at + to_days(14) window_end from w0)"""
_NORM = "trim(regexp_replace(replace(strip_accents(lower({})), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_KEY = "trim(regexp_replace(regexp_replace(" + _NORM.format("title") + ", '[^0-9a-z ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_hit = lambda terms, tail: f"list_filter({terms}, lambda t: regexp_matches({_NORM.format('title')}, '(^|[^0-9a-z])' || regexp_escape({_NORM.format('t')}) || '{tail}'))"
_TOPO, _THEME = _hit("list_concat(place_terms, region_terms)", "([^0-9a-z]|$)"), _hit("stems", "")
_SCORED = f"""scored as (select *, case when not list_contains(languages, "language") then 'language' when not (starts_with(url, 'http://') or starts_with(url, 'https://')) then 'url' when len(topo) = 0 then 'toponym'
  when not (seendate between window_start and window_end) then 'temporal' when len(theme) = 0 then 'thematic' end reason from (select *, {_TOPO} topo, {_THEME} theme from articles, watches))"""
_CAND = "cand as (select * from scored where len(place_terms) > 0 and seendate between window_start and window_end and contains(lower(full_text), lower(place_terms[1])))"
_RANK = "ranks as (select 'src' || cast(i * 3 as varchar) \"domain\", i domain_rank from range(0, 4) t(i))"
_FUSED = f"""keyed as (select c.*, {_KEY} k, coalesce(domain_rank, 1073741824) r from cand c left join ranks using ("domain") where reason is null),
fused as (select * from (select *, row_number() over (partition by aoi_id, k order by r, seendate, article_id, url) rn,
  list(url) over (partition by aoi_id, k order by r, seendate, article_id, url rows between unbounded preceding and unbounded following) us from keyed) where rn = 1)"""


def _watches(spark, sf_dir):
    """The watches as a table with one row per watch, each sized by its text, read with the articles."""
    rows = spark.createDataFrame(list(WATCHES), "aoi_id int, place_terms array<string>, region_terms array<string>, stems array<string>, languages array<string>, before_at string, after_at string")
    return A.fusion_window(rows.withColumns({c: F.col(c).cast("timestamp") for c in ("before_at", "after_at")}))


def _articles(spark, sf_dir):
    return table(spark, sf_dir, "articles")


def _scored(spark, sf_dir):
    return A.score_articles(_articles(spark, sf_dir), _watches(spark, sf_dir))


def _hits(spark, sf_dir):
    """All articles under all watches, which are few and fixed, with the terms in their titles."""
    watches = _watches(spark, sf_dir)
    return A.term_hits(_articles(spark, sf_dir).join(F.broadcast(watches)), watches)


def _ranks(spark):
    return spark.range(4).selectExpr("concat('src', id * 3) domain", "cast(id as int) domain_rank")


def _fused(spark, sf_dir):
    return A.fuse_articles(_articles(spark, sf_dir), _watches(spark, sf_dir), _ranks(spark))


@query(duck("""select scene_id, greatest(b, captured_at - to_days(400)) - to_days(30) window_start, captured_at + to_days(14) window_end from (select scene_id, captured_at, captured_at - to_days(cast(scene_id % 900 as int)) b from scenes)""", "scenes"))
def fusion_window(spark, sf_dir):
    s = table(spark, sf_dir, "scenes").selectExpr("scene_id", "captured_at after_at", "captured_at - make_dt_interval(cast(scene_id % 900 as int)) before_at")
    return A.fusion_window(s).select("scene_id", "window_start", "window_end")


@query(duck(f"select article_id, {_NORM.format('title')} norm from articles", "articles"))
def normalize_text(spark, sf_dir):
    return _articles(spark, sf_dir).select("article_id", C.normalize_text(F.col("title")).alias("norm"))


@query(duck("select aoi_id, article_id, array_to_string(topo, ',') hits from scored", "articles", extra=_WATCH + ", " + _SCORED))
def match_terms(spark, sf_dir):
    return _hits(spark, sf_dir).select("aoi_id", "article_id", F.array_join("toponym", ",").alias("hits"))


@query(duck("select aoi_id, article_id, array_to_string(theme, ',') hits from scored", "articles", extra=_WATCH + ", " + _SCORED))
def match_stems(spark, sf_dir):
    return _hits(spark, sf_dir).select("aoi_id", "article_id", F.array_join("thematic", ",").alias("hits"))


@query(duck("""select aoi_id, article_id, reason is null passed, case when reason in ('language', 'url') then '' else array_to_string(topo, ',') end toponym, reason is null or reason = 'thematic' temporal,
  case when reason is null then array_to_string(theme, ',') else '' end thematic, reason from scored""", "articles", extra=_WATCH + ", " + _SCORED))
def score_articles(spark, sf_dir):
    g = _scored(spark, sf_dir).select("aoi_id", "article_id", "gate.*")
    return g.withColumns({c: F.array_join(c, ",") for c in ("toponym", "thematic")})


@query(duck("select aoi_id, article_id from cand", "articles", extra=", ".join((_WATCH, _SCORED, _CAND))))
def article_candidates(spark, sf_dir):
    return A.article_candidates(_articles(spark, sf_dir), _watches(spark, sf_dir)).select("aoi_id", "article_id")


@query("""select n_nationkey aoi_id, concat('"', n_name, '" (theme:FLOOD OR theme:R', cast(n_regionkey as varchar), ')') query from nation""")
def retrieval_query(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("aoi_id"), A.retrieval_query(F.col("n_name"), F.array(F.lit("FLOOD"), F.concat(F.lit("R"), "n_regionkey"))).alias("query"))


@query(duck(f"select article_id, {_KEY} key from articles", "articles"))
def title_key(spark, sf_dir):
    return _articles(spark, sf_dir).select("article_id", C.title_key(F.col("title")).alias("key"))


#: Pages of the duplicates in ``us``, whose first is the survivor.
_PAGES = f"unnest(range(0, greatest(1, cast(ceil((len(us) - 1) / {PAGE}.0) as bigint))))"
_PAGE = f"array_to_string(us[2 + page * {PAGE}:1 + (page + 1) * {PAGE}], ' ') duplicates"


@query(duck(f"""select title_key, article_id, cast(page as int) page, {_PAGE} from (select k title_key, first_id article_id, us, {_PAGES} page from (select k, arg_min(article_id, (r, seendate, article_id, url)) first_id, list(url order by r, seendate, article_id, url) us from
  (select a.*, {_KEY} k, coalesce(domain_rank, 1073741824) r from articles a left join ranks using ("domain")) group by k))""", "articles", extra=_RANK))
def dedupe_articles(spark, sf_dir):
    out = A.dedupe_articles(_articles(spark, sf_dir).withColumn("aoi_id", F.lit(0)), _ranks(spark))
    return out.select("title_key", "article_id", "page", F.array_join("duplicates", " ").alias("duplicates"))


@query(duck(f"""select aoi_id, article_id, url, title, "domain", "language", seendate, array_to_string(topo, ',') toponym, array_to_string(theme, ',') thematic, cast(page as int) page, {_PAGE} from (select *, {_PAGES} page from fused)""", "articles", extra=", ".join((_WATCH, _SCORED, _CAND, _RANK, _FUSED))))
def fuse_articles(spark, sf_dir):
    out = _fused(spark, sf_dir)
    return out.withColumns({c: F.array_join(c, " " if c == "duplicates" else ",") for c in ("toponym", "thematic", "duplicates")})


@query(duck("select aoi_id, article_id, seendate, cast(row_number() over (partition by aoi_id order by seendate, article_id) as int) place from fused", "articles", extra=", ".join((_WATCH, _SCORED, _CAND, _RANK, _FUSED))))
def articles_for_pair(spark, sf_dir):
    return A.articles_for_pair(_fused(spark, sf_dir)).select("aoi_id", "article_id", "seendate", "place")


@query(duck("select aoi_id, count(*) candidates, count(*) filter (reason is null) admitted, " + ", ".join(f"count(*) filter (reason = '{r}') rejected_{r}" for r in ("language", "url", "toponym", "temporal", "thematic")) + " from scored group by aoi_id", "articles", extra=_WATCH + ", " + _SCORED))
def gate_funnel(spark, sf_dir):
    return A.gate_funnel(_scored(spark, sf_dir))
