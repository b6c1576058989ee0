"""Queries of scoring and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.functions import geodesy as Y
from groundshift.operators import geometry as M
from groundshift.operators import pixels as P
from groundshift.operators import regions as G
from groundshift.operators import scoring as S
from groundshift.sources.fixtures import duck, read, table

from .queries_regions import KEPT, LABELS, MAPS, _pixels, _rounded, cleaned, labelled
from .registry import query

TRUTH = "row >= 12 and row < 22 and col >= 4 and col < 24"
_TRUE = f"tp as (select m.aoi_id, m.row, m.col, vertical, hit predicted, ({TRUTH}) truth, usable \"valid\", ndwi_before, scl from rules m)"
_COUNT = 'count(*) filter ("valid" and predicted and truth) tp, count(*) filter ("valid" and predicted and not truth) fp, count(*) filter ("valid" and not predicted and truth) fn, count(*) filter ("valid" and not predicted and not truth) tn'
_RATIO = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) iou, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1"
_EMIT = f"""em as (select p.aoi_id, p.row, p.col, vertical, l.region_id is not null predicted, ({TRUTH.replace('row', 'p.row').replace('col', 'p.col')}) truth, usable "valid", ndwi_before, scl from rules p
  left join (select l.* from lab l join kept k on l.aoi_id = k.aoi_id and l.region_id = k.region_id) l on p.aoi_id = l.aoi_id and p.row = l.row and p.col = l.col)"""
_EMITTED = KEPT + ", " + _EMIT


def _scored(spark, sf_dir):
    maps = P.rule_mask(P.change_maps(_pixels(spark, sf_dir)))
    return maps.select("aoi_id", "row", "col", "vertical", F.col("hit").alias("predicted"), F.expr(TRUTH).alias("truth"), F.col("usable").alias("valid"), "ndwi_before", F.col("scl").alias("scl0"))


def _emitted(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    kept, labels = G.detect_changes(pixels)
    rows = P.index_deltas(pixels).select("aoi_id", "row", "col", "vertical", F.expr(TRUTH).alias("truth"), F.col("usable").alias("valid"), "ndwi_before", F.col("scl").alias("scl0"))
    return S.emitted_mask(rows, labels), kept, labels


@query(duck(f"select aoi_id, {_COUNT} from tp group by aoi_id", "pixels", extra=MAPS + ", " + _TRUE))
def confusion_counts(spark, sf_dir):
    return S.confusion_counts(_scored(spark, sf_dir))


_ORDERS = 'c as (select o_custkey, count(*) filter (o_orderstatus = \'F\') tp, count(*) filter (o_orderstatus = \'O\') fp, count(*) filter (o_orderstatus = \'P\') fn, count(*) tn from orders where o_custkey % 3 <> 0 or o_orderstatus = \'X\' group by all)'


@query(duck(f"select vertical, aoi_id, tp, fp, fn, tn, {_RATIO} from (select vertical, aoi_id, {_COUNT} from tp group by rollup(vertical, aoi_id))", "pixels", extra=MAPS + ", " + _TRUE))
def micro_average(spark, sf_dir):
    return _rounded(S.micro_average(S.confusion_counts(_scored(spark, sf_dir), ("vertical", "aoi_id")), ["vertical", "aoi_id"]))


@query(duck("select aoi_id, row, col, predicted from em", "pixels", extra=_EMITTED))
def emitted_mask(spark, sf_dir):
    return _emitted(spark, sf_dir)[0].select("aoi_id", "row", "col", "predicted")


THRESHOLDS = (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
_SWEEP = f"""sw as (select th threshold, aoi_id, row, col, coalesce(usable and ssim_dissim >= th, false) hit, usable from maps, (select unnest({list(THRESHOLDS)}::double[]) th) where vertical = 0),
{cleaned('sw', 'threshold, aoi_id')}, {labelled('sw_clean', 'sl', 'threshold, aoi_id')},
sk as (select threshold, aoi_id, region_id from sl group by all having count(*) * 100 >= 5000),
se as (select s.threshold, s.aoi_id, s.row, s.col, x.region_id is not null predicted, ({TRUTH.replace('row', 's.row').replace('col', 's.col')}) truth, s.usable "valid" from sw s
  left join (select sl.* from sl join sk on sl.threshold = sk.threshold and sl.aoi_id = sk.aoi_id and sl.region_id = sk.region_id) x on s.threshold = x.threshold and s.aoi_id = x.aoi_id and s.row = x.row and s.col = x.col)"""


@query(duck(f"select threshold, tp, fp, fn, tn, {_RATIO} from (select threshold, {_COUNT} from se group by threshold)", "pixels", extra=MAPS + ", " + _SWEEP))
def threshold_sweep(spark, sf_dir):
    maps = G.materialize(P.change_maps(_pixels(spark, sf_dir).where("vertical = 0")).withColumn("truth", F.expr(TRUTH)).withColumnRenamed("usable", "valid"), "maps")
    # the threshold's place becomes part of the area's number, so one run of the region operators serves all thresholds
    place = F.array_position(F.array(*map(F.lit, THRESHOLDS)), F.col("threshold")).cast("int")
    hits = S.threshold_sweep(maps.withColumnRenamed("valid", "usable"), list(THRESHOLDS)).select((F.col("aoi_id") * 100 + place).alias("aoi_id"), "row", "col", F.lit(True).alias("hit"))
    labels = G.connected_regions(hits)
    stats = labels.groupBy("aoi_id", "region_id").agg(F.lit(0).alias("vertical"), (F.count(F.lit(1)) * 100.0).alias("area_m2"))
    large = G.materialize(G.min_area_filter(stats), "sweep-large")
    kept = G.keep_near_largest(large, labels.join(large.select("aoi_id", "region_id"), ["aoi_id", "region_id"]))
    emitted = labels.join(kept.select("aoi_id", "region_id"), ["aoi_id", "region_id"]).select(F.expr("aoi_id div 100").cast("int").alias("aoi_id"), F.get(F.array(*map(F.lit, THRESHOLDS)), (F.col("aoi_id") % 100 - 1).cast("int")).alias("threshold"), "row", "col")
    emitted = emitted.join(maps.select("aoi_id", "row", "col", "truth", "valid").hint("merge"), ["aoi_id", "row", "col"])
    return _rounded(S.score_ratios(S.sweep_counts(emitted, maps, list(THRESHOLDS))))


@query(duck(f"select aoi_id, tp, fp, fn, tn, {_RATIO}, round(share, 6) change_share from (select aoi_id, {_COUNT}, avg(case when truth then 1.0 else 0.0 end) filter (\"valid\") share from em group by rollup(aoi_id))", "pixels", extra=_EMITTED))
def scene_scores(spark, sf_dir):
    pixels = G.materialize(_emitted(spark, sf_dir)[0], "emitted")
    share = pixels.where("valid").rollup("aoi_id").agg(F.avg(F.col("truth").cast("double")).alias("change_share"))
    scores = S.micro_average(S.confusion_counts(pixels), ["aoi_id"]).alias("s")
    return _rounded(scores.join(share.withColumnRenamed("aoi_id", "a"), F.col("aoi_id").eqNullSafe(F.col("a"))).drop("a"))


_ID_SQL = """ft as (select o_orderkey, case when o_orderkey % 11 = 1 then '02' else '01' end feature_aoi, case when o_orderkey % 7 = 1 then '2024-05-08' when o_orderkey % 7 = 2 then '09/05/2024' else '08/05/2024' end source_dat,
  case when o_orderkey % 5 = 1 then 'Manual' else 'Semi-automatic extraction' end det_method, case when o_orderkey % 13 = 1 then null else 'Inland flood' end flood_type, case when o_orderkey % 17 = 1 then 'x' when o_orderkey % 17 = 2 then '0' else cast(o_totalprice as varchar) end area_ha, o_orderkey % 19 <> 1 has_geometry from orders)"""
_FEATURE = ["o_orderkey", "case when o_orderkey % 11 = 1 then '02' else '01' end feature_aoi", "case when o_orderkey % 7 = 1 then '2024-05-08' when o_orderkey % 7 = 2 then '09/05/2024' else '08/05/2024' end source_dat",
            "case when o_orderkey % 5 = 1 then 'Manual' else 'Semi-automatic extraction' end det_method", "case when o_orderkey % 13 = 1 then null else 'Inland flood' end flood_type",
            "case when o_orderkey % 17 = 1 then 'x' when o_orderkey % 17 = 2 then '0' else cast(o_totalprice as string) end area_ha", "o_orderkey % 19 <> 1 has_geometry"]


@query(duck("""select o_orderkey, case when feature_aoi <> '01' then 'aoi' when try_strptime(source_dat, '%d/%m/%Y') is distinct from timestamp '2024-05-08' then 'date' when det_method is distinct from 'Semi-automatic extraction' then 'method'
  when flood_type is distinct from 'Inland flood' then 'type' when coalesce(try_cast(area_ha as double), 0) <= 0 then 'area' when not has_geometry then 'geometry' end reject from ft""", extra=_ID_SQL))
def truth_identity(spark, sf_dir):
    return S.truth_identity(read(spark, sf_dir, "orders").selectExpr(*_FEATURE), "01", "2024-05-08").select("o_orderkey", "reject")


_INC = ["l_orderkey", "l_linenumber", "case when l_linenumber = 7 then 'HIDROGRAFIA' else 'DESMATAMENTO' end main_class", "case when l_suppkey % 9 = 1 then 'd2023' else 'd2024' end class_name", "case when l_suppkey % 7 = 1 then 'cerrado' else ' Amazonia' end source",
        "case when l_partkey % 3 = 0 then 'pa ' else 'AM' end state", "case when l_partkey % 5 = 4 then '2023' else '2024' end year", "case when l_suppkey % 11 = 1 then 'nan' when l_suppkey % 11 = 2 then '-1' else '2.5' end area_km",
        "case when l_suppkey % 13 = 1 then '20241345' else '20240716' end image_date", "case when l_suppkey % 17 = 1 then ' ' else concat('u', cast(l_orderkey as {t})) end uuid"]


@query(duck("""select l_orderkey, l_linenumber, main_class, uuid, case when main_class <> 'DESMATAMENTO' then 'main class' when class_name <> 'd2024' then 'class name' when lower(trim(source)) <> 'amazonia' then 'source'
  when area_km in ('nan', '-1') then 'area' when image_date = '20241345' then 'date' when trim(uuid) = '' then 'uuid' when count(*) over (partition by trim(uuid)) > 1 then 'duplicate uuid' end reject from inc where "year" = '2024' and upper(trim(state)) = 'PA'""", extra="inc as (select " + ", ".join(x.replace(" year", ' "year"') for x in _INC).format(t="varchar") + " from lineitem)"))
def increment_identity(spark, sf_dir):
    features = read(spark, sf_dir, "lineitem").selectExpr(*[x.format(t="string") for x in _INC])
    return S.increment_identity(features, 2024).select("l_orderkey", "l_linenumber", "main_class", "uuid", "reject")


@query("""with t as (select c_custkey % 50 aoi_id, date '2024-01-01' + cast(c_custkey % 90 as int) d from customer), w as (select distinct c_custkey % 50 + x aoi_id, date '2024-01-10' b, date '2024-03-01' a from customer, (values (0), (50)) v(x))
select w.aoi_id, coalesce(string_agg(distinct cast(d as varchar), ' ' order by cast(d as varchar)) filter (d < b or d > a), '') outside, count(d) = 0 no_truth from w left join t on w.aoi_id = t.aoi_id group by w.aoi_id""")
def truth_date_bracket(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    truth = c.selectExpr("c_custkey % 50 aoi_id", "date_add(date'2024-01-01', cast(c_custkey % 90 as int)) image_date")
    windows = c.selectExpr("explode(array(c_custkey % 50, c_custkey % 50 + 50)) aoi_id", "date'2024-01-10' before_date", "date'2024-03-01' after_date").distinct()
    out = S.truth_date_bracket(truth, windows)
    return out.withColumn("outside", F.array_join(F.transform("outside", lambda d: d.cast("string")), " "))


_WET = 'coalesce(ndwi_before, -1) > -0.05'


def _variant(name, water):
    kept = f"(truth and not {water})"
    return f'count(*) filter ("valid" and predicted and {kept}) {name}_tp, count(*) filter ("valid" and predicted and not {kept}) {name}_fp, count(*) filter ("valid" and not predicted and {kept}) {name}_fn, round(coalesce(100.0::double * count(*) filter ("valid" and truth and {water}) / nullif(count(*) filter ("valid" and truth), 0), 0), 6) {name}_overlap_pct'


@query(duck(f"select aoi_id, {_variant('ndwi', f'({_WET})')}, {_variant('scl', '(scl = 9)')} from tp group by aoi_id", "pixels", extra=MAPS + ", " + _TRUE))
def water_sensitivity(spark, sf_dir):
    return _rounded(S.water_sensitivity(_scored(spark, sf_dir), water_class=9))


@query(duck(f"""select aoi_id, region_id, v valid_pixels, t truth_pixels, case when v = 0 then 'no_valid_pixels' when t = 0 then 'zero_truth_overlap' when t = v then 'full_truth_overlap' else 'partial_truth_overlap' end overlap from
  (select l.aoi_id, l.region_id, count(*) filter (e."valid") v, count(*) filter (e."valid" and e.truth) t from lab l join kept k on l.aoi_id = k.aoi_id and l.region_id = k.region_id join em e on e.aoi_id = l.aoi_id and e.row = l.row and e.col = l.col group by all)""", "pixels", extra=_EMITTED))
def diagnose_detections(spark, sf_dir):
    pixels, _, labels = _emitted(spark, sf_dir)
    return S.diagnose_detections(pixels, labels)


@query(duck(f"""select s.aoi_id, truth_ha, valid_share, coalesce(detections, 0) detections, coalesce(emitted_ha, 0) emitted_ha, tp, fp, fn, tn, {_RATIO} from
  (select aoi_id, round(count(*) filter ("valid" and truth) * 100.0::double / 10000, 6) truth_ha, round(avg(case when "valid" then 1.0 else 0.0 end), 6) valid_share, {_COUNT} from em group by aoi_id) s
  left join (select aoi_id, count(*) detections, round(sum(area_m2) / 10000, 6) emitted_ha from kept group by aoi_id) k on s.aoi_id = k.aoi_id""", "pixels", extra=_EMITTED))
def benchmark_summary(spark, sf_dir):
    pixels, kept, _ = _emitted(spark, sf_dir)
    return _rounded(S.benchmark_summary(pixels, kept))


@query(duck(f"select aoi_id, round(count(*) filter ({_WET}) / cast(count(*) as double), 6) water_share from em where predicted group by aoi_id", "pixels", extra=_EMITTED))
def preexisting_water_share(spark, sf_dir):
    return _rounded(S.preexisting_water_share(_emitted(spark, sf_dir)[0]))


@query(duck("select min(minx) minx, min(miny) miny, max(maxx) maxx, max(maxy) maxy from aois", "aois"))
def combined_bounds(spark, sf_dir):
    return S.combined_bounds(table(spark, sf_dir, "aois"))


# geometry ---------------------------------------------------------------------------------------

_ZONE = f"({Y.A * Y.A * (1 - Y.E2) / 2!r}::double * (sin(radians({{0}})) / (1 - {Y.E2!r}::double * sin(radians({{0}})) ** 2) + {1 / (2 * Y.E)!r}::double * ln((1 + {Y.E!r}::double * sin(radians({{0}}))) / (1 - {Y.E!r}::double * sin(radians({{0}}))))))"


@query(duck(f"select aoi_id, round(abs(radians(maxx - minx) * ({_ZONE.format('maxy')} - {_ZONE.format('miny')})) / 1e6, 4) area_km2, abs(radians(maxx - minx) * ({_ZONE.format('maxy')} - {_ZONE.format('miny')})) / 1e6 > 500 too_large from b", "aois", extra="b as (select aoi_id, minx, miny, maxx + (aoi_id % 3) * 0.3 maxx, maxy + (aoi_id % 3) * 0.2 maxy from aois)"))
def geodesic_area_km2(spark, sf_dir):
    boxes = table(spark, sf_dir, "aois").selectExpr("aoi_id", "minx", "miny", "maxx + (aoi_id % 3) * 0.3D maxx", "maxy + (aoi_id % 3) * 0.2D maxy")
    return M.geodesic_area_km2(M.box_edges(boxes, ["aoi_id"]), ["aoi_id"]).withColumn("area_km2", F.round("area_km2", 4))


_series = lambda c, f, x, y, op, s: f" {s} ".join([f"{op}"] + [f"({v!r}::double * {f[0]}(2 * {j} * {x}) * {f[1]}(2 * {j} * {y}))" for j, v in enumerate(c, 1)])
_TO_LL = f"""u0 as (select *, (y - case when epsg >= 32700 then 10000000.0::double else 0 end) / {Y.K0 * Y.RADIUS!r}::double xi, (x - 500000.0::double) / {Y.K0 * Y.RADIUS!r}::double eta from v),
u1 as (select *, {_series(Y.BETA, ('sin', 'cosh'), 'xi', 'eta', 'xi', '-')} xp, {_series(Y.BETA, ('cos', 'sinh'), 'xi', 'eta', 'eta', '-')} ep from u0),
u2 as (select *, asin(sin(xp) / cosh(ep)) chi from u1),
ll as (select *, (epsg % 100) * 6 - 183 + degrees(atan2(sinh(ep), cos(xp))) lon, degrees(chi{''.join(f' + {d!r}::double * sin(2 * {j} * chi)' for j, d in enumerate(Y.DELTA, 1))}) lat from u2)"""


@query(duck("select c_custkey, round(case when epsg = 4326 then x else lon end, 7) lon, round(case when epsg = 4326 then y else lat end, 7) lat from ll", extra="v as (select c_custkey, 300000 + c_acctbal * 30 x, 1000000.0::double + c_custkey * 500 y, case when c_custkey % 7 = 0 then 4326 when c_custkey % 2 = 0 then 32622 else 32722 end epsg from customer), " + _TO_LL))
def to_wgs84(spark, sf_dir):
    v = read(spark, sf_dir, "customer").selectExpr("c_custkey", "300000 + c_acctbal * 30 x", "1000000.0D + c_custkey * 500 y", "case when c_custkey % 7 = 0 then 4326 when c_custkey % 2 = 0 then 32622 else 32722 end epsg")
    return M.vertices_to_wgs84(v).select("c_custkey", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


def _forward(n):
    return f"""f{n}0 as (select *, radians(y{n}) ph, radians(x{n} - ((epsg % 100) * 6 - 183)) dl from gr), f{n}1 as (select *, sinh(atanh(sin(ph)) - {Y.E!r}::double * atanh({Y.E!r}::double * sin(ph))) t from f{n}0),
f{n}2 as (select *, atan2(t, cos(dl)) xi, atanh(sin(dl) / sqrt(1 + t * t)) eta from f{n}1),
f{n} as (select aoi_id, seq, (500000.0::double + {Y.K0 * Y.RADIUS!r}::double * ({_series(Y.ALPHA, ('cos', 'sinh'), 'xi', 'eta', 'eta', '+')}) - x0g) / 10 gx, (10000000.0::double + {Y.K0 * Y.RADIUS!r}::double * ({_series(Y.ALPHA, ('sin', 'cosh'), 'xi', 'eta', 'xi', '+')}) - y0g) / -10 gy from f{n}2)"""


_GRIDS = """gr as (select aoi_id, cast(s as int) seq, case s when 0 then minx when 3 then minx else maxx end x0, case s when 0 then miny when 1 then miny else maxy end y0, case s when 0 then maxx when 1 then maxx else minx end x1, case s when 3 then miny when 0 then miny else maxy end y1,
  cast(32700 + floor((minx + 180) / 6) + 1 as int) epsg, 200000.0::double x0g, 9000000.0::double y0g from aois, range(0, 4) r(s))"""


@query(duck("select a.aoi_id, a.seq, round(a.gx, 3) x0, round(a.gy, 3) y0, round(b.gx, 3) x1, round(b.gy, 3) y1 from f0 a join f1 b on a.aoi_id = b.aoi_id and a.seq = b.seq", "aois", extra=", ".join((_GRIDS, _forward(0), _forward(1)))))
def truth_to_grid(spark, sf_dir):
    boxes = table(spark, sf_dir, "aois")
    grids = boxes.selectExpr("aoi_id", "cast(32700 + floor((minx + 180) / 6) + 1 as int) epsg", "10.0D a", "-10.0D e", "200000.0D x0g", "9000000.0D y0g")
    out = M.edges_to_grid(M.box_edges(boxes, ["aoi_id"]), grids)
    return out.select("aoi_id", "seq", *[F.round(c, 3).alias(c) for c in M.EDGE])


#: Corners (x, y) of the truth polygon of every area, at quarter pixels, and of a second one that overlaps it.
_PENTAGON = ((4.25, 12.25), (24.25, 12.25), (24.25, 22.25), (14.3, 26.25), (4.25, 22.25))
_SLAB = ((20.25, 15.75), (31.75, 15.75), (31.75, 18.25), (20.25, 18.25))
_EDGES = [(k, i, *a, *b) for k, ring in enumerate((_PENTAGON, _SLAB)) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))]
_POLY = "ed as (select aoi_id, p.* from (select distinct aoi_id from pixels), (values " + ", ".join(str(e) for e in _EDGES) + ") p(polygon, seq, x0, y0, x1, y1)), ring as (select aoi_id, polygon, x0, y0, x1, y1 from (select aoi_id, cast(polygon as int) polygon, x0::double x0, y0::double y0, x1::double x1, y1::double y1 from ed))"
_INSIDE = """cells as (select distinct g.aoi_id, g.row, g.col from pixels g join (select g.aoi_id, g.row, g.col, e.polygon from pixels g join ring e on g.aoi_id = e.aoi_id and ((y0 > g.row + 0.5) <> (y1 > g.row + 0.5)) and g.col + 0.5 < x0 + (g.row + 0.5 - y0) * (x1 - x0) / (y1 - y0)
  group by all having count(*) % 2 = 1) i on i.aoi_id = g.aoi_id and i.row = g.row and i.col = g.col)"""


def _rings(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(e[0]).alias("polygon"), F.lit(e[1]).alias("seq"), *[F.lit(float(v)).alias(n) for v, n in zip(e[2:], M.EDGE, strict=True)]) for e in _EDGES]))
    return _pixels(spark, sf_dir).select("aoi_id").distinct().select("aoi_id", each.alias("e")).select("aoi_id", "e.*")


@query(duck("select aoi_id, row, col from cells", "pixels", extra=_POLY + ", " + _INSIDE))
def rasterize_polygons(spark, sf_dir):
    return M.rasterize_polygons(_rings(spark, sf_dir))


@query("""select c_custkey aoi_id, cast(w * w as double) area_m2, round(abs(w * w - o) / o, 8) error, abs(w * w - o) / o <= 0.002 ok from (select c_custkey, 100 + c_custkey % 50 w, (100 + c_custkey % 50) * (100 + c_custkey % 50) * (1 + (c_custkey % 5) / 1000.0::double) o from customer)""")
def polygon_area_check(spark, sf_dir):
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey aoi_id", "cast(100 + c_custkey % 50 as double) w", "c_custkey % 5 k")
    boxes = c.selectExpr("aoi_id", "5.0D minx", "7.0D miny", "5 + w maxx", "7 + w maxy")
    out = M.polygon_area_check(M.box_edges(boxes, ["aoi_id"]), c.selectExpr("aoi_id", "w * w * (1 + k / 1000.0D) official_m2"))
    return out.select("aoi_id", F.round("area_m2", 4).alias("area_m2"), F.round("error", 8).alias("error"), "ok")


@query(duck("""select l.aoi_id, l.region_id, count(c.row) shared, round(count(c.row) / cast(count(*) + any_value(n) - count(c.row) as double), 6) iou, round(count(c.row) / cast(count(*) as double), 6) covered from lab l left join cells c on l.aoi_id = c.aoi_id and l.row = c.row and l.col = c.col
  join (select aoi_id, count(*) n from cells group by aoi_id) t on t.aoi_id = l.aoi_id group by l.aoi_id, l.region_id""", "pixels", extra=", ".join((LABELS, _POLY, _INSIDE))))
def region_overlap(spark, sf_dir):
    labels = G.connected_regions(P.clean_mask(P.rule_mask(P.change_maps(_pixels(spark, sf_dir))).select("aoi_id", "row", "col", "hit")))
    return _rounded(M.region_overlap(labels, M.rasterize_polygons(_rings(spark, sf_dir))))


_MEETS = """greatest(0, case when x1 <> x0 then least(({x0} - x0) / nullif(x1 - x0, 0), ({x1} - x0) / nullif(x1 - x0, 0)) when x0 between {x0} and {x1} then 0 else 2 end, case when y1 <> y0 then least(({y0} - y0) / nullif(y1 - y0, 0), ({y1} - y0) / nullif(y1 - y0, 0)) when y0 between {y0} and {y1} then 0 else 2 end)
 <= least(1, case when x1 <> x0 then greatest(({x0} - x0) / nullif(x1 - x0, 0), ({x1} - x0) / nullif(x1 - x0, 0)) else 1 end, case when y1 <> y0 then greatest(({y0} - y0) / nullif(y1 - y0, 0), ({y1} - y0) / nullif(y1 - y0, 0)) else 1 end)"""


@query(duck("select distinct l.aoi_id, l.region_id from lab l where exists (from cells c where c.aoi_id = l.aoi_id and c.row = l.row and c.col = l.col) or exists (from ring e where e.aoi_id = l.aoi_id and " + _MEETS.format(x0="l.col", x1="(l.col + 1)", y0="l.row", y1="(l.row + 1)") + ")", "pixels", extra=", ".join((LABELS, _POLY, _INSIDE))))
def intersects_filter(spark, sf_dir):
    labels = G.connected_regions(P.clean_mask(P.rule_mask(P.change_maps(_pixels(spark, sf_dir))).select("aoi_id", "row", "col", "hit")))
    return M.intersects_filter(labels, _rings(spark, sf_dir))


_BOXES = "bx as (select c_custkey aoi_id, (c_custkey % 37) * 1.0::double wminx, (c_custkey % 29) * 1.0::double wminy, c_custkey % 37 + 1.5::double wmaxx, c_custkey % 29 + 1.5::double wmaxy from customer), pe as (select b.*, p.* from bx b, (values " + ", ".join(str(e) for e in _EDGES) + ") p(polygon, seq, x0, y0, x1, y1)), pf as (select aoi_id, wminx, wminy, wmaxx, wmaxy, cast(polygon as int) polygon, x0::double x0, y0::double y0, x1::double x1, y1::double y1 from pe)"


@query(duck("select aoi_id, polygon from pf group by all having bool_or(" + _MEETS.format(x0="wminx", x1="wmaxx", y0="wminy", y1="wmaxy") + ") or count(*) filter ((y0 > wminy) <> (y1 > wminy) and wminx < x0 + (wminy - y0) * (x1 - x0) / nullif(y1 - y0, 0)) % 2 = 1", extra=_BOXES).replace("from pf group by all", "from pf group by aoi_id, polygon"))
def truth_in_window(spark, sf_dir):
    windows = read(spark, sf_dir, "customer").selectExpr("c_custkey aoi_id", "(c_custkey % 37) * 1.0D wminx", "(c_custkey % 29) * 1.0D wminy", "c_custkey % 37 + 1.5D wmaxx", "c_custkey % 29 + 1.5D wmaxy")
    each = F.explode(F.array(*[F.struct(F.lit(e[0]).alias("polygon"), *[F.lit(float(v)).alias(n) for v, n in zip(e[2:], M.EDGE, strict=True)]) for e in _EDGES]))
    return M.truth_in_window(windows.select("aoi_id", each.alias("e")).select("aoi_id", "e.*"), windows)
