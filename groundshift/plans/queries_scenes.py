"""Queries of sources and scene selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.functions import columns as C
from groundshift.operators import pixels as P
from groundshift.operators import scenes as S
from groundshift.sources import readers as R
from groundshift.sources.fixtures import BANDS, duck, read, table

from .registry import query

ITEM_SQL = """items as (select event_id, concat('S2', cast(event_id as varchar)) stac_id, ts captured_at, value cloud_pct,
  case event_id % 3 when 0 then cast(32600 + user_id % 60 + 1 as int) end own, case when event_id % 3 = 1 then concat('EPSG:', cast(32700 + user_id % 60 + 1 as varchar)) when event_id % 3 = 2 then 'none' end code,
  case event_id % 4 when 0 then '02.14' when 1 then '04.00' when 2 then '05.11' else 'bad' end baseline, case when event_id % 5 <> 0 then event_id % 2 = 0 end applied from events)"""


def items(spark, sf_dir):
    """Catalogue items as JSON documents made from the events, parsed by the reader's schema."""
    e = read(spark, sf_dir, "events")
    zone = (F.col("user_id") % 60 + 1).cast("int")
    props = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("datetime"), F.col("value").alias("eo:cloud_cover"), F.when(F.col("event_id") % 3 == 0, zone + 32600).alias("proj:epsg"),
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("EPSG:"), zone + 32700)).when(F.col("event_id") % 3 == 2, "none").alias("proj:code"),
        F.element_at(F.array(*map(F.lit, ("02.14", "04.00", "05.11", "bad"))), (F.col("event_id") % 4 + 1).cast("int")).alias("s2:processing_baseline"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 2 == 0).alias("earthsearch:boa_offset_applied"),
    )
    href = lambda k: F.struct(F.concat(F.lit(k + "/"), "event_id").alias("href"))
    assets = F.create_map(*[x for k in ("red", "nir", "thumbnail") for x in (F.lit(k), href(k))])
    return R.items_from_json(e.select(F.to_json(F.struct(F.concat(F.lit("S2"), "event_id").alias("id"), props.alias("properties"), assets.alias("assets"))).alias("item")))


_EPSG = "coalesce(own, try_cast(nullif(regexp_extract(coalesce(code, ''), '^EPSG:([0-9]+)$', 1), '') as int))"
_OFFSET = "cast(case when coalesce(try_cast(baseline as double), 0) >= 4 and not coalesce(applied, false) then -1000 else 0 end as int)"


@query(duck(f"""select stac_id, 'sentinel-2-l2a' collection, captured_at, cloud_pct, {_EPSG} epsg, concat('nir/', cast(event_id as varchar), ';red/', cast(event_id as varchar)) assets,
  {_OFFSET} dn_offset, case when {_EPSG} is null then 'no projection' end error from items""", extra=ITEM_SQL))
def scenes_from_items(spark, sf_dir):
    rows = R.scenes_from_items(items(spark, sf_dir))
    return rows.withColumn("assets", F.array_join(F.array_sort(F.map_values("assets")), ";"))


@query(duck(f"select stac_id, {_EPSG} epsg from items", extra=ITEM_SQL))
def scene_epsg(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("id").alias("stac_id"), R.scene_epsg().alias("epsg"))


@query(duck(f"select stac_id, {_OFFSET} dn_offset from items", extra=ITEM_SQL))
def boa_offset(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("id").alias("stac_id"), R.boa_offset().alias("dn_offset"))


@query("""select concat('https://', source, '/', cast(doc_id as varchar)) url, trim(split_part(text, '.', 1)) title, cast(date '2023-06-01' + cast(doc_id % 500 as int) as timestamp) seendate, source domain, lang "language"
  from documents where doc_id % 13 <> 0 and doc_id % 7 <> 0 and doc_id % 19 <> 0""")
def articles_from_artlist(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") % 500).cast("int"))
    one = F.struct(
        F.when(F.col("doc_id") % 13 != 0, F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id")).alias("url"), F.concat(F.lit(" "), F.split_part("text", F.lit("."), F.lit(1)), F.lit(" ")).alias("title"),
        F.when(F.col("doc_id") % 7 == 0, "yesterday").otherwise(F.date_format(day, "yyyyMMdd'T'000000'Z'")).alias("seendate"), F.col("source").alias("domain"), F.col("lang").alias("language"),
    )
    body = F.when(F.col("doc_id") % 19 == 0, "Your query was too short.").otherwise(F.to_json(F.struct(F.array(one).alias("articles"))))
    return R.articles_from_artlist(d.select(body.alias("body")))


@query("""with a as (select n_nationkey k, [[cast(-60 + 3 * n_nationkey as double), 1.0], [-60 + 3 * n_nationkey + 0.5, 1.0], [-60 + 3 * n_nationkey + 0.5, 2.0], [cast(-60 + 3 * n_nationkey as double), 1.0]] p, n_name from nation),
e as (select k, n_name, s, p[s + 1] a, p[s + 2] b from (select *, unnest(range(0, 3)) s from a))
select k source, 0 feature, 0 ring, cast(s as int) seq, a[1] x0, a[2] y0, b[1] x1, b[2] y1, n_name "name" from e""")
def truth_from_geojson(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    x = (F.lit(-60) + 3 * F.col("n_nationkey")).cast("double")
    ring = F.array(*[F.array(a, F.lit(b)) for a, b in ((x, 1.0), (x + 0.5, 1.0), (x + 0.5, 2.0), (x, 1.0))])
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(F.struct(F.col("n_name").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("features")))
    schema = "struct<type: string, features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>>"
    attributes, edges = R.truth_from_geojson(n.select(F.col("n_nationkey").alias("source"), F.from_json(doc, schema).alias("d")).select("source", "d.features"))
    return edges.join(attributes, ["source", "feature"]).select("source", "feature", "ring", "seq", "x0", "y0", "x1", "y1", F.col("properties")["name"].alias("name"))


def _bounds(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr("c_custkey aoi_id", "10.0D a", "-10.0D e", "500000.0D x0", "1000000.0D y0", "500000 + c_acctbal / 40 minx", "500000 + c_acctbal / 40 + 95 maxx", "999900 - c_acctbal / 50 miny", "1000000 - c_acctbal / 50 maxy")


_BOUNDS = "b as (select c_custkey aoi_id, 500000 + c_acctbal / 40 minx, 500000 + c_acctbal / 40 + 95 maxx, 999900 - c_acctbal / 50 miny, 1000000 - c_acctbal / 50 maxy from customer)"
_CLIP = "w as (select aoi_id, cast(floor((1000000.0::double - maxy) / 10.0::double) as bigint) row_off, cast(floor((minx - 500000.0::double) / 10.0::double) as bigint) col_off, cast(ceil((1000000.0::double - miny) / 10.0::double) as bigint) row_end, cast(ceil((maxx - 500000.0::double) / 10.0::double) as bigint) col_end from b)"


@query(duck("select * from w", extra=_BOUNDS + ", " + _CLIP))
def window_clip(spark, sf_dir):
    return S.window_clip(_bounds(spark, sf_dir))


@query(duck("select aoi_id, row_off >= 0 and col_off >= 0 and row_end <= 50 and col_end <= 50 covered from w", extra=_BOUNDS + ", " + _CLIP))
def coverage_check(spark, sf_dir):
    b = _bounds(spark, sf_dir)
    return S.coverage_check(S.window_clip(b), b.selectExpr("aoi_id", "50 height", "50 width")).select("aoi_id", "covered")


@query(duck("select p.aoi_id, p.row, p.col, p.red1 from pixels p join w on p.aoi_id = w.aoi_id where row >= row_off and row < row_end and col >= col_off and col < col_end", "pixels", extra=_BOUNDS + ", " + _CLIP))
def window_read(spark, sf_dir):
    windows = S.window_clip(_bounds(spark, sf_dir))
    return S.read_window(table(spark, sf_dir, "pixels").select("aoi_id", "row", "col", "red1"), windows.withColumn("aoi_id", F.col("aoi_id").cast("int")))


@query(duck("select a.aoi_id, a.row, a.col, b.scl scl20 from pixels a join pixels b on a.aoi_id = b.aoi_id and b.row = cast(floor((a.row + 0.5) / 2) as int) and b.col = cast(floor((a.col + 0.5) / 2) as int)", "pixels"))
def scl_resample(spark, sf_dir):
    p = table(spark, sf_dir, "pixels")
    return S.scl_resample(p.select("aoi_id", "row", "col"), p.select("aoi_id", "row", "col", "scl"))


@query("select vec_id, embedding[2] blue, embedding[3] green, embedding[4] red, embedding[8] nir, 4 scl from embeddings where vec_id % 3 <> 0")
def msi_band_select(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    planes = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 12)).otherwise(F.slice("embedding", 1, 13))
    return S.msi_band_select(v.select("vec_id", planes.alias("planes")))


_LABELS = "l as (select aoi_id, row, col, case when aoi_id % 4 = 1 and row = 3 and col = 3 then 0 when (row + col) % 5 = 0 then 2 else 1 end \"value\" from pixels)"


@query(duck("select aoi_id, row, col, \"value\" = 2 changed from l where aoi_id not in (select aoi_id from l where \"value\" not in (1, 2))", "pixels", extra=_LABELS))
def decode_labels(spark, sf_dir):
    p = table(spark, sf_dir, "pixels")
    return S.decode_labels(p.selectExpr("aoi_id", "row", "col", "case when aoi_id % 4 = 1 and row = 3 and col = 3 then 0 when (row + col) % 5 = 0 then 2 else 1 end value"))


@query(duck("""select split_part(stac_id, '_', 1) platform, split_part(stac_id, '_', 2) tile, split_part(stac_id, '_', 3) "day", count(*) n, arg_min(scene_id, (captured_at, scene_id)) first_item, arg_min(scene_id, (cloud_pct, scene_id)) clearest_item
  from scenes group by all having count(*) > 1""", "scenes"))
def acquisition_variants(spark, sf_dir):
    return S.acquisition_variants(table(spark, sf_dir, "scenes"))


_REQ = "req as (select distinct aoi_id, cast(date '2024-01-03' + cast(aoi_id as int) as date) s, cast(date '2024-01-06' + cast(aoi_id as int) as date) e from scenes)"
_WIN = "win as (select aoi_id, cast(step as int) step, s, cast(e + cast(step as int) as date) e from (select *, unnest(range(0, 61, 15)) step from req))"


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "scenes").select("aoi_id").distinct().selectExpr("aoi_id", "date_add(date'2024-01-03', aoi_id) start", "date_add(date'2024-01-06', aoi_id) end")


@query(duck('select aoi_id, step, s "start", e "end" from win', "scenes", extra=_REQ + ", " + _WIN))
def candidate_windows(spark, sf_dir):
    return S.candidate_windows(_requests(spark, sf_dir))


@query(duck("""select aoi_id, scene_id, place from (select s.aoi_id, scene_id, cast(row_number() over (partition by s.aoi_id order by captured_at, scene_id) as int) place from scenes s join req r on s.aoi_id = r.aoi_id
  and cast(captured_at as date) between r.s and r.e where cloud_pct < 60) where place <= 64""", "scenes", extra=_REQ))
def scene_search(spark, sf_dir):
    return S.scene_search(table(spark, sf_dir, "scenes"), _requests(spark, sf_dir), 60.0).select("aoi_id", "scene_id", "place")


@query(duck("select aoi_id, round(avg(case when scl in (0,1,3,8,9,10,11) then 0.0 else 1.0 end), 6) usable_fraction from pixels group by aoi_id", "pixels"))
def usable_fraction(spark, sf_dir):
    return S.usable_fraction(table(spark, sf_dir, "pixels")).withColumn("usable_fraction", F.round("usable_fraction", 6))


_PICK = """select aoi_id, scene_id, step, cloud_pct, usable_fraction from (select s.*, w.step, row_number() over (partition by s.aoi_id order by w.step, cloud_pct, captured_at, scene_id) place
  from scenes s join win w on s.aoi_id = w.aoi_id and cast(captured_at as date) between w.s and w.e where usable_fraction >= 0.7) where place = 1"""


@query(duck(_PICK, "scenes", extra=_REQ + ", " + _WIN))
def select_usable_scene(spark, sf_dir):
    return S.select_usable_scene(table(spark, sf_dir, "scenes"), _requests(spark, sf_dir))


_LONG = "b as (" + " union all ".join(f"select aoi_id, row, col, '{x}1' band, {x}1 \"value\" from pixels" for x in BANDS) + ")"


@query(duck("""select b.aoi_id, row, col, band, case when off = 0 then "value" else greatest("value" + off, 0) end "value", off applied from b join
  (select aoi_id, case when aoi_id % 4 = 0 then 0 when avg(case when "value" <= 1000 then 1.0 else 0.0 end) > 0.5 then 0 else -1000 end off from b where "value" > 0 group by aoi_id) o on b.aoi_id = o.aoi_id""", "pixels", extra=_LONG))
def harmonize(spark, sf_dir):
    p = table(spark, sf_dir, "pixels")
    offsets = p.select("aoi_id").distinct().selectExpr("aoi_id", "case when aoi_id % 4 = 0 then 0 else -1000 end dn_offset")
    return S.harmonize(S.long_bands(p, [f"{b}1" for b in BANDS]), offsets)


@query(duck("select scene_id, cast(strptime(split_part(stac_id, '_', 3), '%Y%m%d') as date) captured, cast(case when substr(split_part(stac_id, '_', 2), 3, 1) < 'N' then 32700 else 32600 end + cast(left(split_part(stac_id, '_', 2), 2) as int) as int) epsg from scenes", "scenes"))
def scene_id_parts(spark, sf_dir):
    return table(spark, sf_dir, "scenes").select("scene_id", C.capture_date(F.col("stac_id")).alias("captured"), C.epsg_of_tile(F.col("stac_id")).alias("epsg"))


@query(duck("select scene_id, case when scene_id % 3 = 0 then 'own' else 'sentinel-2-l2a' end collection, case when scene_id % 2 = 0 then 4326 else epsg end epsg, cloud_pct from scenes", "scenes"))
def scene_meta_backfill(spark, sf_dir):
    meta = F.to_json(F.struct(F.when(F.col("scene_id") % 3 == 0, "own").alias("collection"), F.when(F.col("scene_id") % 2 == 0, 4326).alias("epsg")))
    return S.scene_meta_backfill(table(spark, sf_dir, "scenes").select("scene_id", meta.alias("meta"), F.col("epsg").alias("own_epsg"), F.col("cloud_pct").alias("own_cloud")))


@query("select c_custkey aoi_id, case when c_custkey % 7 = 1 then 'crs' when c_custkey % 7 = 2 then 'shape' when c_custkey % 7 = 3 then 'transform' end error from customer")
def coregistration_check(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    head = lambda n: c.selectExpr("c_custkey aoi_id", f"32600 + if({n} = 1 and c_custkey % 7 = 1, 1, 0) epsg", "50 height", f"50 + if({n} = 1 and c_custkey % 7 = 2, 1, 0) width", "10.0D a", "-10.0D e", f"500000.0D + if({n} = 1 and c_custkey % 7 = 3, 10, 0) x0", "1000000.0D y0")
    return S.coregistration_check(head(0), head(1))


_ENDS = 'q as (select aoi_id, band, quantile_cont("value", 0.02) lo, quantile_cont("value", 0.98) hi from b group by all)'


@query(duck("""select b.aoi_id, row, col, b.band, cast(case when hi > lo then floor(least(greatest(("value" - lo) / (hi - lo), 0.0), 1.0) * 255.0) else 0 end as int) "level" from b join q on b.aoi_id = q.aoi_id and b.band = q.band""", "pixels", extra=_LONG + ", " + _ENDS))
def percentile_stretch(spark, sf_dir):
    return P.percentile_stretch(S.long_bands(table(spark, sf_dir, "pixels"), [f"{b}1" for b in BANDS]))


ACTIVE = "act as (select * from (select *, row_number() over (partition by aoi_id order by created_at desc, job_id desc) rn from jobs where status = 'succeeded' and after_scene_id is not null) where rn = 1)"


@query(duck("""select s.aoi_id, scene_id, captured_at, cast(row_number() over (partition by s.aoi_id order by captured_at, scene_id) as int) place from scenes s left join act a on s.aoi_id = a.aoi_id
  where a.after_scene_id is null or scene_id in (a.before_scene_id, a.after_scene_id)""", "scenes", "jobs", extra=ACTIVE))
def pair_scene_list(spark, sf_dir):
    return S.pair_scene_list(table(spark, sf_dir, "scenes"), S.active_pair(table(spark, sf_dir, "jobs")))


@query(duck("select aoi_id, job_id, before_scene_id, after_scene_id from act", "jobs", extra=ACTIVE))
def latest_succeeded_job(spark, sf_dir):
    return S.active_pair(table(spark, sf_dir, "jobs")).select("aoi_id", "job_id", "before_scene_id", "after_scene_id")


@query(duck("""select aoi_id, scene_id, round((epoch_us(captured_at) / 1e6 - min(epoch_us(captured_at) / 1e6) over w) / greatest(max(epoch_us(captured_at) / 1e6) over w - min(epoch_us(captured_at) / 1e6) over w, 86400.0::double) * 100, 6) "position" from scenes window w as (partition by aoi_id)""", "scenes"))
def timeline_position(spark, sf_dir):
    return S.timeline_position(table(spark, sf_dir, "scenes")).withColumn("position", F.round("position", 6))
