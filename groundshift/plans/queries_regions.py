"""Queries of pixel algebra, neighbourhoods and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundshift.functions import columns as C
from groundshift.operators import pixels as P
from groundshift.operators import presets as D
from groundshift.operators import regions as G
from groundshift.sources.fixtures import duck, table

from .registry import query

_OK = "scl not in (0,1,3,8,9,10,11)"
_idx = lambda a, b, n: f"case when {_OK} then cast({a}{n} - {b}{n} as double) / nullif({a}{n} + {b}{n}, 0) end"


def _ssim():
    sums = ", ".join(f"sum({v}) over w {n}" for n, v in (("x", "x"), ("y", "y"), ("xx", "xx"), ("yy", "yy"), ("xy", "xy")))
    base = f"""s0 as (select aoi_id, row, col, cast(red0 as bigint) x, cast(red1 as bigint) y, cast(red0 as bigint) * red0 xx, cast(red1 as bigint) * red1 yy, cast(red0 as bigint) * red1 xy, max(row) over (partition by aoi_id, col) + 1 h from pixels)"""
    def mirror(src, axis, size):
        parts = [f"select * from {src}"] + [f"select * replace (-1 - {k} as {axis}) from {src} where {axis} = {k}" for k in range(3)] + [f"select * replace ({size} + {k} as {axis}) from {src} where {axis} = {size} - 1 - {k}" for k in range(3)]
        return " union all ".join(parts)
    return f"""{base}, s1 as ({mirror('s0', 'row', 'h')}),
s2 as (select * from (select aoi_id, row, col, h, {sums} from s1 window w as (partition by aoi_id, col order by row range between 3 preceding and 3 following)) where row >= 0 and row < h),
s3 as (select *, max(col) over (partition by aoi_id, row) + 1 wd from s2), s4 as ({mirror('s3', 'col', 'wd')}),
s5 as (select * from (select aoi_id, row, col, wd, {sums} from s4 window w as (partition by aoi_id, row order by col range between 3 preceding and 3 following)) where col >= 0 and col < wd),
s6 as (select aoi_id, row, col, x / 49.0::double x, y / 49.0::double y, xx / 49.0::double xx, yy / 49.0::double yy, xy / 49.0::double xy from s5),
ssim as (select aoi_id, row, col, 1 - ((2 * x * y + 1e4) * (2 * (49.0::double / 48) * (xy - x * y) + 9e4)) / ((x * x + y * y + 1e4) * ((49.0::double / 48) * (xx - x * x) + (49.0::double / 48) * (yy - y * y) + 9e4)) ssim_dissim from s6)"""


MAPS = f"""{_ssim()},
idx as (select *, {_OK} usable, {_idx('nir', 'red', 0)} ndvi_before, {_idx('nir', 'red', 1)} ndvi_after, {_idx('green', 'nir', 0)} ndwi_before, {_idx('green', 'nir', 1)} ndwi_after from pixels),
maps as (select i.aoi_id, i.row, i.col, vertical, scl, usable, ndvi_after - ndvi_before ndvi, ndwi_after - ndwi_before ndwi, ndvi_before, ndwi_before, ssim_dissim from idx i join ssim s on i.aoi_id = s.aoi_id and i.row = s.row and i.col = s.col),
rules as (select *, coalesce(usable and case vertical when 0 then ssim_dissim >= 0.55 when 1 then ndvi <= -0.15 and ndvi_before >= 0.5 else ndwi >= 0.2 and ndwi_before <= -0.05 end, false) hit from maps)"""


def _step(src, dst, grow, keys="aoi_id"):
    out = []
    for i, (axis, other) in enumerate((("row", "col"), ("col", "row"))):
        a, b = (src, f"{dst}_h") if i == 0 else (f"{dst}_h", dst)
        value = "bool_or(hit) over w" if grow else "bool_and(hit) over w and count(*) over w = 3"
        out.append(f"{b} as (select * replace ({value} as hit) from {a} window w as (partition by {keys}, {other} order by {axis} range between 1 preceding and 1 following))")
    return ", ".join(out)


def cleaned(src, keys="aoi_id"):
    return ", ".join((_step(src, f"{src}_e", False, keys), _step(f"{src}_e", f"{src}_o", True, keys), _step(f"{src}_o", f"{src}_d", True, keys), _step(f"{src}_d", f"{src}_clean", False, keys)))


def labelled(src, name="lab", keys="aoi_id"):
    """Recursive labels of the true pixels of ``src``: region is the least (row << 20 | lo) run reached."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{name}_runs as (select {keys}, row, min(col) lo, max(col) hi, (cast(row as bigint) << 20) | min(col) node from (select *, col - row_number() over (partition by {keys}, row order by col) island from {src} where hit) group by {keys}, row, island),
{name}_e0 as (select {', '.join('a.' + k for k in keys.split(', '))}, a.node a, b.node b from {name}_runs a join {name}_runs b on {on} and a.row = b.row + 1 and a.lo <= b.hi and b.lo <= a.hi),
{name}_e as (select {keys}, a, b from {name}_e0 union all select {keys}, b, a from {name}_e0),
{name}_reach as (select {keys}, node, node root from {name}_runs union select r.* replace (e.b as node) from {name}_reach r join {name}_e e on {' and '.join(f'r.{k} = e.{k}' for k in keys.split(', '))} and r.node = e.a where e.b > r.root),
{name}_root as (select {keys}, node, min(root) region_id from {name}_reach group by all),
{name} as (select r.*, q.region_id from (select {keys}, row, node, cast(unnest(range(lo, hi + 1)) as int) col from {name}_runs) r join {name}_root q on {' and '.join(f'r.{k} = q.{k}' for k in keys.split(', '))} and r.node = q.node)"""


STATS = """stats as (select l.aoi_id, l.region_id, any_value(vertical) vertical, count(*) n_pixels, count(*) * 100.0::double area_m2,
  coalesce(avg(abs(case vertical when 0 then ssim_dissim when 1 then ndvi else ndwi end)), 0) magnitude, coalesce(avg(case vertical when 0 then cast(ssim_dissim >= 0.55 as int) when 1 then cast(ndvi <= -0.15 as int) else cast(ndwi >= 0.2 as int) end), 0) confidence,
  coalesce(avg(ndvi), 0) mean_ndvi, coalesce(avg(ndvi_before), 0) mean_ndvi_before, coalesce(avg(ndwi), 0) mean_ndwi, coalesce(avg(ndwi_before), 0) mean_ndwi_before, coalesce(avg(ssim_dissim), 0) mean_ssim_dissim
  from lab l join maps m on l.aoi_id = m.aoi_id and l.row = m.row and l.col = m.col group by l.aoi_id, l.region_id),
large as (select * from stats where area_m2 >= case vertical when 0 then 5000 when 1 then 3000 else 10000 end)"""
NEAR = """anchor as (select * from (select *, row_number() over (partition by aoi_id order by area_m2 desc, region_id) rn from large where vertical = 0) where rn = 1),
gaps as (select l.aoi_id, l.region_id, min(sqrt(greatest(0, abs(l.row - b.row) - 1) ** 2 + greatest(0, abs(l.col - b.col) - 1) ** 2) * 10) d from lab l join anchor a on l.aoi_id = a.aoi_id join lab b on b.aoi_id = a.aoi_id and b.region_id = a.region_id group by all),
kept as (select g.* from large g left join gaps using (aoi_id, region_id) where vertical <> 0 or d <= 2000)"""
LABELS = ", ".join((MAPS, cleaned("rules"), labelled("rules_clean")))
KEPT = ", ".join((LABELS, STATS, NEAR))
_round = "round(magnitude, 6) magnitude, round(confidence, 6) confidence, round(mean_ndvi, 6) mean_ndvi, round(mean_ndvi_before, 6) mean_ndvi_before, round(mean_ndwi, 6) mean_ndwi, round(mean_ndwi_before, 6) mean_ndwi_before, round(mean_ssim_dissim, 6) mean_ssim_dissim"
_STAT_COLUMNS = f"aoi_id, region_id, vertical, n_pixels, area_m2, {_round}"


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "pixels")


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double" and c != "area_m2"})


def _rules(spark, sf_dir):
    return P.rule_mask(P.change_maps(_pixels(spark, sf_dir)))


def _clean(spark, sf_dir):
    return P.clean_mask(_rules(spark, sf_dir).select("aoi_id", "row", "col", "hit"))


def _labels(spark, sf_dir):
    return G.connected_regions(_clean(spark, sf_dir))


@query(duck(f"select aoi_id, row, col, case when {_OK} then red1 end red1, case when {_OK} then nir1 end nir1 from pixels", "pixels"))
def mask_unusable(spark, sf_dir):
    return P.mask_unusable(_pixels(spark, sf_dir), ["red1", "nir1"]).select("aoi_id", "row", "col", "red1", "nir1")


@query(duck("select aoi_id, row, col, round(cast(nir1 - red1 as double) / nullif(nir1 + red1, 0), 6) v from pixels", "pixels"))
def ndvi(spark, sf_dir):
    return _pixels(spark, sf_dir).select("aoi_id", "row", "col", F.round(C.ndvi(F.col("red1"), F.col("nir1")), 6).alias("v"))


@query(duck("select aoi_id, row, col, round(cast(green1 - nir1 as double) / nullif(green1 + nir1, 0), 6) v from pixels", "pixels"))
def ndwi(spark, sf_dir):
    return _pixels(spark, sf_dir).select("aoi_id", "row", "col", F.round(C.ndwi(F.col("green1"), F.col("nir1")), 6).alias("v"))


@query(duck("select aoi_id, row, col, round(cast(nir1 - (blue1 - 300) as double) / nullif(nir1 + blue1 - 300, 0), 6) v from pixels", "pixels"))
def nbr(spark, sf_dir):
    return _pixels(spark, sf_dir).select("aoi_id", "row", "col", F.round(C.nbr(F.col("nir1"), F.col("blue1") - 300), 6).alias("v"))


@query(duck("select aoi_id, row, col, round(d, 6) delta from (select aoi_id, row, col, cast(nir1 - red1 as double) / nullif(nir1 + red1, 0) - cast(nir0 - red0 as double) / nullif(nir0 + red0, 0) d from pixels)", "pixels"))
def index_delta(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    date = lambda n: p.select("aoi_id", "row", "col", F.col(f"red{n}").alias("red"), F.col(f"nir{n}").alias("nir"))
    after = date(1).unionByName(date(1).withColumn("row", F.col("row") + 1000))  # the later scene reaches further
    met = P.pair_scenes(date(0), after, ["red", "nir"])
    return met.select("aoi_id", "row", "col", F.round(C.ndvi(F.col("red1"), F.col("nir1")) - C.ndvi(F.col("red0"), F.col("nir0")), 6).alias("delta"))


@query(duck("select aoi_id, row, col, round(ndvi, 6) ndvi, round(ndwi, 6) ndwi, round(ndvi_before, 6) ndvi_before, round(ndwi_before, 6) ndwi_before, round(ssim_dissim, 6) ssim_dissim, usable from maps", "pixels", extra=MAPS))
def change_maps(spark, sf_dir):
    out = P.change_maps(_pixels(spark, sf_dir))
    return _rounded(out.select("aoi_id", "row", "col", "ndvi", "ndwi", "ndvi_before", "ndwi_before", "ssim_dissim", "usable"))


@query(duck("select aoi_id, row, col, round(ssim_dissim, 6) ssim_dissim from ssim", "pixels", extra=_ssim()))
def ssim_dissimilarity(spark, sf_dir):
    return _rounded(P.ssim_dissimilarity(_pixels(spark, sf_dir)))


@query(duck("select aoi_id, row, col, hit from rules", "pixels", extra=MAPS))
def rule_mask(spark, sf_dir):
    return _rules(spark, sf_dir).select("aoi_id", "row", "col", "hit")


_PRESET_SQL = """p as (select * from (values (0, 'port', 'construction', 'ssim_dissim', 'increase', 0.55::double, true, 5000.0::double, 2000.0::double), (1, 'forest', 'vegetation_loss', 'ndvi', 'decrease', 0.15, true, 3000, null), (1, 'forest', 'vegetation_loss', 'ndvi_before', 'increase', 0.5, false, 3000, null),
  (2, 'flood', 'flooding', 'ndwi', 'increase', 0.2, true, 10000, null), (2, 'flood', 'flooding', 'ndwi_before', 'decrease', 0.05, false, 10000, null)) t(v, vertical, change_type, map, direction, threshold, is_primary, min_area_m2, focus_radius_m))"""


@query(duck("select aoi_id, p.vertical, change_type, map, direction, threshold, is_primary, min_area_m2, focus_radius_m from aois a join p on a.vertical = p.v", "aois", extra=_PRESET_SQL))
def preset_rules(spark, sf_dir):
    names = F.array(*[F.lit(p.vertical) for p in D.PRESETS])
    aois = table(spark, sf_dir, "aois").select("aoi_id", F.get(names, F.col("vertical")).alias("vertical"))
    return aois.join(F.broadcast(D.preset_table(spark)), "vertical")


@query(duck("select aoi_id, p.vertical, map, case when map = 'ndvi' then 0.25::double else threshold end threshold, 4000.0::double min_area_m2 from aois a join p on a.vertical = p.v where p.v = 1", "aois", extra=_PRESET_SQL))
def preset_override(spark, sf_dir):
    changed = D.override(D.PRESETS[1], {"ndvi": 0.25}, 4000.0)
    aois = table(spark, sf_dir, "aois").where("vertical = 1").select("aoi_id", F.lit("forest").alias("vertical"))
    return aois.join(F.broadcast(D.preset_table(spark, [changed])), "vertical").select("aoi_id", "vertical", "map", "threshold", "min_area_m2")


_RANDOM = "rnd as (select aoi_id, row, col, (red1 * 7 + nir1 * 3 + row) % 5 <> 0 hit from pixels)"


def _random(spark, sf_dir):
    return _pixels(spark, sf_dir).selectExpr("aoi_id", "row", "col", "(red1 * 7 + nir1 * 3 + row) % 5 <> 0 hit")


@query(duck("select * from ero", "pixels", extra=_RANDOM + ", " + _step("rnd", "ero", False)))
def binary_erosion(spark, sf_dir):
    return P.binary_erosion(_random(spark, sf_dir))


@query(duck("select * from dil", "pixels", extra="rn as (select aoi_id, row, col, (red1 * 7 + nir1 * 3 + row) % 5 = 0 hit from pixels), " + _step("rn", "dil", True)))
def binary_dilation(spark, sf_dir):
    return P.binary_dilation(_random(spark, sf_dir).withColumn("hit", ~F.col("hit")))


@query(duck("select aoi_id, row, col, hit from rules_clean", "pixels", extra=MAPS + ", " + cleaned("rules")))
def clean_mask(spark, sf_dir):
    return _clean(spark, sf_dir)


@query(duck("select aoi_id, row, min(col) lo, max(col) hi from (select *, col - row_number() over (partition by aoi_id, row order by col) island from rnd where hit) group by aoi_id, row, island", "pixels", extra=_RANDOM))
def row_runs(spark, sf_dir):
    return G.row_runs(_random(spark, sf_dir))


@query(duck("select aoi_id, row, col, region_id from lab", "pixels", extra=LABELS))
def connected_regions(spark, sf_dir):
    return _labels(spark, sf_dir)


@query(duck(f"select {_STAT_COLUMNS} from stats", "pixels", extra=", ".join((LABELS, STATS))))
def region_stats(spark, sf_dir):
    maps = G.materialize(P.change_maps(_pixels(spark, sf_dir)), "maps")
    clean = P.clean_mask(P.rule_mask(maps).select("aoi_id", "row", "col", "hit"))
    return _rounded(G.region_stats(maps, G.connected_regions(clean)))


@query(duck("select aoi_id, region_id, area_m2 from large", "pixels", extra=", ".join((LABELS, STATS))))
def min_area_filter(spark, sf_dir):
    maps = G.materialize(P.change_maps(_pixels(spark, sf_dir)), "maps")
    clean = P.clean_mask(P.rule_mask(maps).select("aoi_id", "row", "col", "hit"))
    return G.min_area_filter(G.region_stats(maps, G.connected_regions(clean))).select("aoi_id", "region_id", "area_m2")


_SIDES = "sides as (select aoi_id, region_id, row + dr r, col + dc c, row + a r0, col + b c0, row + x r1, col + y c1 from lab, (values (-1, 0, 0, 1, 0, 0), (1, 0, 1, 0, 1, 1), (0, -1, 0, 0, 1, 0), (0, 1, 1, 1, 0, 1)) t(dr, dc, a, b, x, y))"


@query(duck("select aoi_id, region_id, r0, c0, r1, c1 from sides s where not exists (from lab l where l.aoi_id = s.aoi_id and l.region_id = s.region_id and l.row = s.r and l.col = s.c)", "pixels", extra=LABELS + ", " + _SIDES))
def region_outline(spark, sf_dir):
    return G.region_outline(_labels(spark, sf_dir))


#: Edges with the one that follows (of two, the left turn), rings by flooding the least edge along them.
_RINGS = _SIDES + """, o as (select *, cast(case when c1 > c0 then 0 when r1 < r0 then 1 when c1 < c0 then 2 else 3 end as int) dir, ((cast(r0 as bigint) << 30) | (c0 << 4)) + case when c1 > c0 then 0 when r1 < r0 then 1 when c1 < c0 then 2 else 3 end id
  from (select aoi_id, region_id, r0, c0, r1, c1 from sides s where not exists (from lab l where l.aoi_id = s.aoi_id and l.region_id = s.region_id and l.row = s.r and l.col = s.c))),
nx as (select e.aoi_id, e.region_id, e.id, any_value(e.dir) dir, arg_max(f.id, (e.r1 - e.r0) * (f.c1 - f.c0) - (e.c1 - e.c0) * (f.r1 - f.r0)) nid, arg_max(f.dir, (e.r1 - e.r0) * (f.c1 - f.c0) - (e.c1 - e.c0) * (f.r1 - f.r0)) ndir
  from o e join o f on e.aoi_id = f.aoi_id and e.region_id = f.region_id and f.r0 = e.r1 and f.c0 = e.c1 group by all),
flood as (select aoi_id, region_id, id node, id root from o union select r.aoi_id, r.region_id, n.nid, r.root from flood r join nx n on n.aoi_id = r.aoi_id and n.region_id = r.region_id and n.id = r.node where n.nid > r.root),
inring as (select aoi_id, region_id, node id, min(root) root from flood group by all),
rsize as (select o.aoi_id, o.region_id, root, cast(count(*) filter (nx.dir <> ndir) as int) n_vertices, sum(c1 * r0 - c0 * r1) / 2.0::double signed_area from o join inring using (aoi_id, region_id, id) join nx using (aoi_id, region_id, id) group by all),
rings as (select *, cast(row_number() over (partition by aoi_id, region_id order by root) - 1 as int) ring from rsize)"""


@query(duck("select aoi_id, region_id, ring, n_vertices, signed_area from rings", "pixels", extra=LABELS + ", " + _RINGS))
def region_rings(spark, sf_dir):
    return G.region_rings(G.region_outline(_labels(spark, sf_dir)), vertices=False)


#: The walk around each ring from its least corner; the corners at which it turns.
_WALK = """, walk as (select aoi_id, region_id, root, root node, 0 k from rings union all select w.aoi_id, w.region_id, w.root, n.nid, w.k + 1 from walk w join nx n on n.aoi_id = w.aoi_id and n.region_id = w.region_id and n.id = w.node where n.nid <> w.root),
turned as (select w.*, r0, c0, n.dir <> p.dir turns from walk w join o on o.aoi_id = w.aoi_id and o.region_id = w.region_id and o.id = w.node join nx n on n.aoi_id = w.aoi_id and n.region_id = w.region_id and n.id = w.node join nx p on p.aoi_id = w.aoi_id and p.region_id = w.region_id and p.nid = w.node),
spelt as (select aoi_id, region_id, root, string_agg(r0 || ' ' || c0, ',' order by k) s from turned where turns group by all)"""


@query(duck("select r.aoi_id, r.region_id, sum(signed_area) * 100 area_m2, cast(count(*) as int) n_rings, string_agg(s, ';' order by signed_area < 0, ring) corners from rings r join spelt using (aoi_id, region_id, root) join (select aoi_id, region_id from kept) using (aoi_id, region_id) group by all", "pixels", extra=", ".join((KEPT, _RINGS)) + _WALK))
def detection_polygons(spark, sf_dir):
    """Detections as polygons in pixel corners; ``regions.detection_geometry`` gives them coordinates."""
    labels = G.detect_changes(_pixels(spark, sf_dir))[1]
    ring = lambda r: F.array_join(F.transform(r, lambda v: F.concat(v["row"].cast("string"), F.lit(" "), v["col"].cast("string"))), ",")
    return G.region_polygons(G.region_outline(labels)).select("aoi_id", "region_id", "area_m2", "n_rings", F.array_join(F.transform("rings", ring), ";").alias("corners"))


@query(duck("select aoi_id, region_id, area_m2 from kept", "pixels", extra=KEPT))
def keep_near_largest(spark, sf_dir):
    return G.detect_changes(_pixels(spark, sf_dir))[0].select("aoi_id", "region_id", "area_m2")


@query(duck(f"select {_STAT_COLUMNS}, case vertical when 0 then 'construction' when 1 then 'vegetation_loss' else 'flooding' end change_type from kept", "pixels", extra=KEPT))
def detect_changes(spark, sf_dir):
    return _rounded(G.detect_changes(_pixels(spark, sf_dir))[0])


@query(duck(f"select aoi_id, round(count(*) filter (hit) * 100.0::double / 10000, 4) flooded_ha, count(*) filter (usable) usable_pixels from (select *, coalesce({_idx('green', 'nir', 1)} - {_idx('green', 'nir', 0)} >= 0.2 and {_idx('green', 'nir', 0)} <= -0.05, false) hit, {_OK} usable from pixels) group by aoi_id", "pixels"))
def flooded_area(spark, sf_dir):
    maps = P.index_deltas(_pixels(spark, sf_dir))
    hit = F.col("usable") & C.passes(F.col("ndwi"), "increase", 0.20) & C.passes(F.col("ndwi_before"), "decrease", 0.05)
    return maps.groupBy("aoi_id").agg(F.round(F.count_if(hit) * 100.0 / 10000, 4).alias("flooded_ha"), F.count_if("usable").alias("usable_pixels"))

