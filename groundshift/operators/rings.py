"""Boundary rings of regions as lists: successors by a join on corners, ranks by pointer jumping.

A boundary edge is a node, its successor the edge that leaves the corner it ends in; where two do, the left turn is
taken, so that rings touch but never cross. Rings are the components of that list. Vertices are where it turns;
each learns how far it is from the end of its ring by following its pointer twice as far, or more, in every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundshift.functions.geodesy import to_wgs84
from groundshift.plans.scratch import materialize

from .components import connected_components

_EAST, _NORTH, _WEST, _SOUTH = range(4)
_CORNER = 21  # bits of a corner's row and column


def _direction() -> Column:
    return F.when(F.col("c1") > F.col("c0"), _EAST).when(F.col("r1") < F.col("r0"), _NORTH).when(F.col("c1") < F.col("c0"), _WEST).otherwise(_SOUTH)


def _node() -> Column:
    """The pixel on the edge's left and its side, which no two edges of an area share."""
    row = F.least("r0", "r1") - F.when(F.col("dir") == _EAST, 1).otherwise(0)
    col = F.least("c0", "c1") - F.when(F.col("dir") == _NORTH, 1).otherwise(0)
    whole = F.col("aoi_id").cast("long") * F.lit(1 << 42) + F.shiftleft(row.cast("long"), 22) + F.shiftleft(col.cast("long"), 2) + F.col("dir")
    return F.when((row < 1 << 20) & (col < 1 << 20), whole).otherwise(F.raise_error(F.lit("a grid may have at most 2^20 rows and columns")))


def linked_edges(outline: DataFrame) -> DataFrame:
    """The edges with node, next (the node of the edge that follows), turn (whether it turns there), dir and root (the ring's number)."""
    edges = materialize(outline.withColumn("dir", _direction()).withColumn("node", _node()), "ring-edges")
    out = edges.select("aoi_id", "region_id", F.col("r0").alias("r1"), F.col("c0").alias("c1"), F.col("node").alias("next"), F.col("dir").alias("next_dir"))
    met = edges.select("aoi_id", "region_id", "r1", "c1", "node", "dir").join(out.hint("merge"), ["aoi_id", "region_id", "r1", "c1"])
    left = F.pmod(F.col("next_dir") - F.col("dir") + 1, F.lit(4))  # 2: to the left, 1: straight on, 0: to the right
    chosen = met.groupBy("node").agg(F.max_by(F.struct("next", "next_dir"), left).alias("n"))
    chosen = materialize(chosen.select("node", F.col("n.next").alias("next"), F.col("n.next_dir").alias("next_dir")), "ring-links")
    found = connected_components(chosen.select(F.col("node").alias("a"), F.col("next").alias("b")))
    whole = edges.join(chosen.hint("merge"), "node").join(found.hint("merge"), "node")
    return materialize(whole.select("aoi_id", "region_id", "r0", "c0", "r1", "c1", "dir", "node", "next", (F.col("dir") != F.col("next_dir")).alias("turn"), "root"), "rings")


def ring_sizes(linked: DataFrame) -> DataFrame:
    """aoi_id, region_id, root, ring (their order by least corner, from 0), n_vertices and signed_area, negative for holes."""
    corner = F.shiftleft(F.col("r0").cast("long"), _CORNER) + F.col("c0")
    doubled = F.sum(F.col("c1").cast("long") * F.col("r0") - F.col("c0").cast("long") * F.col("r1"))
    sized = linked.groupBy("aoi_id", "region_id", "root").agg(F.min(corner).alias("first"), F.count_if("turn").cast("int").alias("n_vertices"), (doubled / 2).alias("signed_area"))
    place = F.row_number().over(Window.partitionBy("aoi_id", "region_id").orderBy("first")) - 1
    return sized.select("aoi_id", "region_id", "root", place.alias("ring"), "n_vertices", "signed_area", "first")


def ranked_vertices(linked: DataFrame) -> DataFrame:
    """root, r0, c0 and left, the number of vertices of its ring from a vertex on; the least corner has them all.

    Straight runs, bounded by the grid's side, are passed over in one step by a window along their line. The rest is
    pointer jumping: in each round a pointer is followed three times more, so a ring of n vertices takes log4 n rounds.
    """
    line = F.when(F.col("dir").isin(_EAST, _WEST), F.col("r0")).otherwise(F.col("c0"))
    along = F.when(F.col("dir") == _EAST, F.col("c0")).when(F.col("dir") == _WEST, -F.col("c0")).when(F.col("dir") == _SOUTH, F.col("r0")).otherwise(-F.col("r0"))
    each = linked.withColumns({"_line": line, "_along": along})
    back = Window.partitionBy("aoi_id", "region_id", "dir", "_line").orderBy(F.desc("_along"))
    # seen from the far end: the last turn passed is the next one ahead, the row after is the edge before
    each = each.withColumn("hop", F.last(F.when(F.col("turn"), F.col("next")), True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    each = each.withColumns({"_before": F.lead("_along").over(back), "_turned": F.lead("turn").over(back)})
    starts = each.where(F.col("_before").isNull() | (F.col("_before") != F.col("_along") - 1) | F.col("_turned")).select("root", "node", "hop", "r0", "c0")
    starts = materialize(starts, "ring-vertices")
    heads = starts.groupBy("root").agg(F.min_by("node", F.shiftleft(F.col("r0").cast("long"), _CORNER) + F.col("c0")).alias("head"))
    state = starts.join(heads.hint("merge"), "root").select("node", F.when(F.col("hop") != F.col("head"), F.col("hop")).alias("hop"), F.lit(1).cast("long").alias("left"))
    state = materialize(state, "ring-ranks")
    while not state.where("hop is not null").isEmpty():
        ahead = state
        for _ in range(3):
            b = state.select(F.col("node").alias("hop"), F.col("hop").alias("hop2"), F.col("left").alias("left2"))
            ahead = ahead.join(b.hint("merge"), "hop", "left").select("node", F.col("hop2").alias("hop"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left"))
        state = materialize(ahead, "ring-ranks")
    return starts.join(state.select("node", "left").hint("merge"), "node").select("root", "r0", "c0", "left")


def region_rings(outline: DataFrame, vertices: bool = True) -> DataFrame:
    """Closed rings of regions: aoi_id, region_id, ring, n_vertices, signed_area and, if asked for, vertices in order from the least corner.

    ``outline`` as from ``regions.region_outline``. Exterior rings have a positive area, holes a negative one. Every
    step is a join or an aggregate over all regions; only the vertices of one ring, a value of the result, come together.
    """
    linked = linked_edges(outline)
    sized = ring_sizes(linked)
    names = ["aoi_id", "region_id", "ring", "n_vertices", "signed_area"]
    if not vertices:
        return sized.select(names)
    lists = ranked_vertices(linked).groupBy("root").agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("place"), F.col("r0").alias("row"), F.col("c0").alias("col")))).alias("v"))
    bare = F.transform("v", lambda v: F.struct(v["row"].alias("row"), v["col"].alias("col")))
    return sized.join(lists.hint("merge"), "root").select(*names, bare.alias("vertices"))


def region_polygons(outline: DataFrame, pixel_area: float = 100.0) -> DataFrame:
    """One polygon a region: aoi_id, region_id, area_m2, n_rings and rings, the shell first, then its holes by least corner.

    Regions are connected by sides, so each has one shell, which holds all of its holes. Every ring is an array of corners (row, col), not closed.
    """
    found = region_rings(outline)
    rings = F.array_sort(F.collect_list(F.struct((F.col("signed_area") < 0).alias("hole"), "ring", "vertices")))
    out = found.groupBy("aoi_id", "region_id").agg((F.sum("signed_area") * pixel_area).alias("area_m2"), F.count(F.lit(1)).cast("int").alias("n_rings"), rings.alias("r"))
    return out.select("aoi_id", "region_id", "area_m2", "n_rings", F.col("r.vertices").alias("rings"))


def polygons_to_wgs84(polygons: DataFrame, grids: DataFrame) -> DataFrame:
    """``polygons`` with geometry, a GeoJSON Polygon in longitude and latitude.

    ``grids`` has a row for each area: aoi_id, epsg, a and e (the pixel's width and, negative, height) and x0g, y0g (the
    upper left corner). Corners are turned into coordinates as rows and put back in order; rings are closed, shells run counterclockwise.
    """
    each = polygons.select("aoi_id", "region_id", F.posexplode("rings").alias("ring", "v")).select("aoi_id", "region_id", "ring", F.posexplode("v").alias("place", "c"))
    at = each.join(grids.hint("merge"), "aoi_id").select("aoi_id", "region_id", "ring", "place", (F.col("x0g") + F.col("c.col") * F.col("a")).alias("x"), (F.col("y0g") + F.col("c.row") * F.col("e")).alias("y"), "epsg")
    lon, lat = to_wgs84(F.col("x"), F.col("y"), F.col("epsg"))
    ring = F.array_sort(F.collect_list(F.struct("place", F.array(lon, lat).alias("at"))))
    rings = at.groupBy("aoi_id", "region_id", "ring").agg(ring["at"].alias("v")).withColumn("v", F.concat("v", F.slice("v", 1, 1)))
    nested = rings.groupBy("aoi_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("ring", "v")))["v"].alias("coordinates"))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col("coordinates")))
    return polygons.join(nested.select("aoi_id", "region_id", shape.alias("geometry")).hint("merge"), ["aoi_id", "region_id"])
