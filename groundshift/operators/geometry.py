"""Polygons as edge tables: areas, coordinates, rasterising and intersections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundshift.functions.geodesy import edge_area, to_utm, to_wgs84
from groundshift.plans.scratch import materialize

MAX_AOI_KM2 = 500.0
AREA_TOLERANCE = 0.002
EDGE = ("x0", "y0", "x1", "y1")
WINDOW = ("wminx", "wminy", "wmaxx", "wmaxy")
#: Cells of a cover have 2^level pixels a side, the largest first; boxes under 2^LEAST_LEVEL share the least level.
COVER_LEVELS = (7, 4)
LEAST_LEVEL = -20


def box_edges(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The four edges of boxes minx, miny, maxx, maxy."""
    c = {k: F.col(k) for k in ("minx", "miny", "maxx", "maxy")}
    corners = [(c["minx"], c["miny"]), (c["maxx"], c["miny"]), (c["maxx"], c["maxy"]), (c["minx"], c["maxy"])]
    sides = F.array(*[F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    return boxes.select(*keys, F.posexplode(sides).alias("seq", "e")).select(*keys, "seq", "e.*")


def geodesic_area_km2(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area_km2 and too_large of lon/lat rings, whatever their direction."""
    area = F.abs(F.sum(edge_area(*[F.col(c) for c in EDGE]))) / 1e6
    return edges.groupBy(*keys).agg(area.alias("area_km2")).withColumn("too_large", F.col("area_km2") > MAX_AOI_KM2)


def vertices_to_wgs84(vertices: DataFrame) -> DataFrame:
    """Rows with x, y and epsg: lon and lat added."""
    lon, lat = to_wgs84(F.col("x"), F.col("y"), F.col("epsg"))
    return vertices.withColumns({"lon": lon, "lat": lat})


def edges_to_grid(edges: DataFrame, grids: DataFrame) -> DataFrame:
    """lon/lat edges in fractional columns and rows of their area's grid (epsg, a, e, x0g, y0g)."""
    met = edges.join(grids.hint("merge"), "aoi_id")
    out = {}
    for n in "01":
        east, north = to_utm(F.col(f"x{n}"), F.col(f"y{n}"), F.col("epsg"))
        out |= {f"gx{n}": (east - F.col("x0g")) / F.col("a"), f"gy{n}": (north - F.col("y0g")) / F.col("e")}
    met = met.select(*[c for c in edges.columns if c not in EDGE], *[v.alias(k) for k, v in out.items()])
    return met.withColumnsRenamed({f"g{c}": c for c in EDGE})


def inside_spans(edges: DataFrame) -> DataFrame:
    """aoi_id, row, lo, hi: the runs of pixels of a row whose centre is inside a polygon of the area.

    Scanlines: every edge gives its crossings with the rows it spans, crossings pair off from left
    to right (even-odd). Spans are closed left and open right; those of different polygons may overlap.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    spans = edges.where(last >= first).select("aoi_id", "polygon", *EDGE, F.explode(F.sequence(first, last)).alias("row"))
    x = F.col("x0") + (F.col("row") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossed = spans.select("aoi_id", "polygon", "row", x.alias("x"))
    order = Window.partitionBy("aoi_id", "polygon", "row").orderBy("x")
    paired = crossed.select("*", F.lead("x").over(order).alias("xe"), F.row_number().over(order).alias("k")).where("k % 2 = 1")
    left, right = F.ceil(F.col("x") - 0.5), F.ceil(F.col("xe") - 0.5) - 1
    return paired.where(right >= left).select("aoi_id", "row", left.alias("lo"), right.alias("hi"))


def touched_spans(edges: DataFrame) -> DataFrame:
    """aoi_id, row, lo, hi: the runs of pixels of a row that an edge runs through."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.select("aoi_id", *EDGE, F.explode(F.sequence(F.floor(low), F.floor(high))).alias("row"))
    dy = F.col("y1") - F.col("y0")
    at = lambda y: F.when(dy == 0, F.col("x0")).otherwise(F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.when(dy != 0, dy))
    a, b = at(F.greatest(F.col("row").cast("double"), low)), at(F.least(F.col("row") + 1.0, high))
    b = F.when(dy == 0, F.col("x1")).otherwise(b)
    return rows.select("aoi_id", "row", F.floor(F.least(a, b)).alias("lo"), F.floor(F.greatest(a, b)).alias("hi"))


def _pixels_of(spans: DataFrame) -> DataFrame:
    cells = spans.select("aoi_id", F.col("row").cast("int").alias("row"), F.explode(F.sequence("lo", "hi")).alias("col"))
    return cells.withColumn("col", F.col("col").cast("int")).distinct()


def rasterize_polygons(edges: DataFrame) -> DataFrame:
    """aoi_id, row, col of the pixels whose centre is inside any polygon of the area, each once."""
    return _pixels_of(inside_spans(edges))


def touched_cells(edges: DataFrame) -> DataFrame:
    """aoi_id, row, col of the pixels that an edge runs through."""
    return _pixels_of(touched_spans(edges))


def _split(spans: DataFrame, level: int) -> DataFrame:
    """Spans cut at the sides of cells of 2^level pixels, with the cell's column."""
    at, side = F.col("cell"), 1 << level
    cut = spans.select("aoi_id", "row", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", level), F.shiftright("hi", level))).alias("cell"))
    return cut.select("aoi_id", "row", F.greatest(F.col("lo"), at * side).alias("lo"), F.least(F.col("hi"), at * side + side - 1).alias("hi"), "cell")


def cover(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aoi_id, level, top, cell of the square cells of 2^level pixels that polygons fill or touch in every pixel; aoi_id, row, lo, hi, cell of the spans outside those).

    Spans of a row are cut at the largest cells first; a cell in which each row has a span over its whole width is one row of
    the cover, and only spans in other cells go on to the next level. So the inside of a large polygon is no row for each pixel.
    """
    spans, inner = inside_spans(edges).unionByName(touched_spans(edges)), []
    for level in COVER_LEVELS:
        cut = materialize(_split(spans, level).withColumn("top", F.shiftright("row", level)).distinct(), "cover-spans")
        full = cut.where(F.col("hi") - F.col("lo") + 1 == 1 << level).groupBy("aoi_id", "top", "cell").agg(F.count_distinct("row").alias("n")).where(F.col("n") == 1 << level)
        full = materialize(full.select("aoi_id", F.lit(level).alias("level"), "top", "cell"), "cover-cells")
        inner.append(full)
        spans = cut.join(full.hint("merge"), ["aoi_id", "top", "cell"], "left_anti").select("aoi_id", "row", "lo", "hi")
    return reduce(DataFrame.unionByName, inner), _split(spans, COVER_LEVELS[-1])


def polygon_area_check(edges: DataFrame, official: DataFrame) -> DataFrame:
    """Projected (shoelace) area against the official one: relative error and whether it is within tolerance."""
    area = F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2)
    met = edges.groupBy("aoi_id").agg(area.alias("area_m2")).join(official.hint("merge"), "aoi_id")
    return met.withColumn("error", F.abs(F.col("area_m2") - F.col("official_m2")) / F.col("official_m2")).withColumn("ok", F.col("error") <= AREA_TOLERANCE)


def region_bounds(outline: DataFrame, selected: DataFrame) -> DataFrame:
    """Union bounds of the selected regions of each area; an area without any has no row."""
    met = outline.join(selected.hint("merge"), ["aoi_id", "region_id"], "left_semi")
    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    return met.groupBy("aoi_id").agg(low("r0", "r1").alias("min_row"), low("c0", "c1").alias("min_col"), high("r0", "r1").alias("max_row"), high("c0", "c1").alias("max_col"))


def region_overlap(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Per region: shared cells with the area's target, IoU and covered share."""
    target = cells.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("target"))
    on = cells.withColumn("_on", F.lit(1))
    got = labels.join(on.hint("merge"), ["aoi_id", "row", "col"], "left").groupBy("aoi_id", "region_id").agg(F.count(F.lit(1)).alias("own"), F.count("_on").alias("shared")).join(target.hint("merge"), "aoi_id")
    return got.select("aoi_id", "region_id", "shared", (F.col("shared") / (F.col("own") + F.col("target") - F.col("shared"))).alias("iou"), (F.col("shared") / F.col("own")).alias("covered"))


def intersects_filter(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """aoi_id, region_id of the regions that a polygon meets: by an inner pixel or its boundary.

    Regions meet the polygons' cover (``cover``): by the different cells of each level that they lie in, and pixel by pixel only
    in cells on a border.
    """
    inner, border = cover(edges)
    found = []
    for level in COVER_LEVELS:
        mine = labels.select("aoi_id", "region_id", F.shiftright("row", level).cast("long").alias("top"), F.shiftright("col", level).cast("long").alias("cell")).distinct()
        found.append(mine.join(inner.where(F.col("level") == level).hint("merge"), ["aoi_id", "top", "cell"], "left_semi").select("aoi_id", "region_id"))
    pixels = labels.select("aoi_id", "region_id", F.col("row").cast("long").alias("row"), "col", F.shiftright("col", COVER_LEVELS[-1]).cast("long").alias("cell"))
    found.append(pixels.join(border.hint("merge"), ["aoi_id", "row", "cell"]).where("col between lo and hi").select("aoi_id", "region_id"))
    return reduce(DataFrame.unionByName, found).distinct()


def _celled(boxes: DataFrame, box: tuple[str, str, str, str], levels: list[int], name: str) -> DataFrame:
    """Boxes with ``name`` (their own level) and a row for each cell (level, cx, cy) that they lie in, at their own level and each larger one of ``levels``."""
    each = F.filter(F.array(*map(F.lit, levels)), lambda m: m >= F.col(name))
    out = boxes.select("*", F.explode(each).alias("level")).withColumn("_size", F.pow(F.lit(2.0), F.col("level")))
    for axis, low, high in (("cx", box[0], box[2]), ("cy", box[1], box[3])):
        out = out.select("*", F.explode(F.sequence(F.floor(F.col(low) / F.col("_size")), F.floor(F.col(high) / F.col("_size")))).alias(axis))
    return out.drop("_size")


def _level(box: tuple[str, str, str, str]) -> Column:
    """Least level whose cells are no smaller than the box, so that it lies in four of them at most (five or six by rounding)."""
    extent = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]))
    return F.when(extent > 2.0**LEAST_LEVEL, F.ceil(F.log2(extent)).cast("int")).otherwise(LEAST_LEVEL)


def box_pairs(left: DataFrame, right: DataFrame, left_box: tuple[str, str, str, str], right_box: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of rows of one aoi_id whose boxes (minx, miny, maxx, maxy) meet, each once; the other columns of both must differ in name.

    Each box lies in a few cells of the level of its size. Two boxes meet in a cell of the larger one's level, so a box takes
    part at its own level and at the larger levels that there are; cells are the key of the join, whatever the sizes. The
    levels, at most some dozens, are the only rows brought to the driver. Boxes with a null or infinite side meet none.
    """
    def ready(rows: DataFrame, box: tuple[str, str, str, str], name: str) -> DataFrame:
        bounded = reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in box])
        return materialize(rows.where(bounded & (F.col(box[0]) <= F.col(box[2])) & (F.col(box[1]) <= F.col(box[3]))).withColumn(name, _level(box)), "boxes")

    a, b = ready(left, left_box, "_la"), ready(right, right_box, "_lb")
    levels = sorted(r[0] for r in a.select("_la").distinct().union(b.select("_lb").distinct()).distinct().collect())
    if not levels:
        levels = [LEAST_LEVEL]
    met = _celled(a, left_box, levels, "_la").join(_celled(b, right_box, levels, "_lb").hint("merge"), ["aoi_id", "level", "cx", "cy"]).where(F.col("level") == F.greatest("_la", "_lb"))
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = [[F.col(c) for c in box] for box in (left_box, right_box)]
    met = met.where((ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1))
    # the one cell that holds the lower corner of what both share
    size = F.pow(F.lit(2.0), F.col("level"))
    return met.where((F.col("cx") == F.floor(F.greatest(ax0, bx0) / size)) & (F.col("cy") == F.floor(F.greatest(ay0, by0) / size))).drop("level", "cx", "cy", "_la", "_lb")


def truth_in_window(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """aoi_id, polygon of the polygons that meet a window (wminx, wminy, wmaxx, wmaxy) of their area, each once.

    Boxes first (``box_pairs``): a polygon whose box lies in a window meets it, and only the edges of those whose box
    crosses a window's side are tested. A polygon meets a box if an edge does, or if a corner of the box lies inside it (odd crossings).
    Edges with a null corner count as none.
    """
    edges = edges.select("aoi_id", "polygon", *EDGE).where(" and ".join(f"{c} is not null" for c in EDGE))
    sides = ("pminx", "pminy", "pmaxx", "pmaxy")
    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    bounds = edges.groupBy("aoi_id", "polygon").agg(low("x0", "x1").alias("pminx"), low("y0", "y1").alias("pminy"), high("x0", "x1").alias("pmaxx"), high("y0", "y1").alias("pmaxy"))
    pairs = materialize(box_pairs(bounds, windows.select("aoi_id", *WINDOW).distinct(), sides, WINDOW), "window-pairs")
    whole = "pminx >= wminx and pmaxx <= wmaxx and pminy >= wminy and pmaxy <= wmaxy"
    sure = pairs.where(whole).select("aoi_id", "polygon").distinct()
    open_pairs = pairs.where(f"not ({whole})").join(sure.hint("merge"), ["aoi_id", "polygon"], "left_anti").select("aoi_id", "polygon", *WINDOW)
    met = edges.join(open_pairs.hint("merge"), ["aoi_id", "polygon"])

    def within(p: str, d, lo: str, hi: str):
        a, b = (F.col(lo) - F.col(p)) / F.when(d != 0, d), (F.col(hi) - F.col(p)) / F.when(d != 0, d)
        inside = F.col(p).between(F.col(lo), F.col(hi))
        return F.when(d != 0, F.least(a, b)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0)), F.when(d != 0, F.greatest(a, b)).otherwise(F.lit(1.0))

    x_in, x_out = within("x0", F.col("x1") - F.col("x0"), "wminx", "wmaxx")
    y_in, y_out = within("y0", F.col("y1") - F.col("y0"), "wminy", "wmaxy")
    crosses = F.greatest(F.lit(0.0), x_in, y_in) <= F.least(F.lit(1.0), x_out, y_out)
    dy = F.col("y1") - F.col("y0")
    right = F.col("x0") + (F.col("wminy") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.when(dy != 0, dy)
    over = ((F.col("y0") > F.col("wminy")) != (F.col("y1") > F.col("wminy"))) & (F.col("wminx") < right)
    got = met.groupBy("aoi_id", "polygon", *WINDOW).agg(F.bool_or(crosses).alias("hit"), F.count_if(over).alias("n"))
    return sure.unionByName(got.where("hit or n % 2 = 1").select("aoi_id", "polygon")).distinct()
