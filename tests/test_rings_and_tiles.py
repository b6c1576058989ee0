"""Rings by list ranking against a walk, polygons and coordinates, and tiles against the whole grid."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundshift.operators import pixels, regions, tiles
from groundshift.operators import rings as R


def walked(cells):
    """Rings of a 4-connected set of pixels: (vertices from the least corner, doubled area), by walking its boundary."""
    out = defaultdict(list)
    for r, c in cells:
        for dr, dc, a, b, x, y in ((-1, 0, 0, 1, 0, 0), (1, 0, 1, 0, 1, 1), (0, -1, 0, 0, 1, 0), (0, 1, 1, 1, 0, 1)):
            if (r + dr, c + dc) not in cells:
                out[r + a, c + b].append((r + x, c + y))
    rings = []
    while out:
        start = min(out)
        path, at, came = [], start, None
        while True:
            path.append(at)
            ways = out[at]
            if came and len(ways) > 1:
                ways.sort(key=lambda w: (at[0] - came[0]) * (w[1] - at[1]) - (at[1] - came[1]) * (w[0] - at[0]))  # noqa: B023
            nxt = ways.pop()
            if not ways:
                del out[at]
            came, at = at, nxt
            if at == start:
                break
        n = len(path)
        turns = [path[i] for i in range(n) if (path[i][0] - path[i - 1][0], path[i][1] - path[i - 1][1]) != (path[(i + 1) % n][0] - path[i][0], path[(i + 1) % n][1] - path[i][1])]
        rings.append((turns, sum(path[(i + 1) % n][1] * path[i][0] - path[i][1] * path[(i + 1) % n][0] for i in range(n))))
    return rings


def blobs(seed, side=24, share=0.62):
    rnd = random.Random(seed)
    return {(r, c) for r in range(side) for c in range(side) if rnd.random() < share}


def test_rings_equal_a_walk_of_the_boundary(spark):
    rows = [(a, r, c, True) for a in range(4) for r, c in blobs(a)]
    rows += [(9, r, c, True) for r in range(90) for c in range(90) if (r + c) % 2 or r % 2]  # a comb with many holes
    labels = regions.connected_regions(spark.createDataFrame(rows, "aoi_id int, row int, col int, hit boolean"))
    by_region = defaultdict(set)
    for r in labels.collect():
        by_region[r.aoi_id, r.region_id].add((r.row, r.col))
    got = defaultdict(dict)
    for r in regions.region_rings(regions.region_outline(labels)).collect():
        got[r.aoi_id, r.region_id][r.ring] = ([(v.row, v.col) for v in r.vertices], r.signed_area, r.n_vertices)
    assert set(got) == set(by_region) and len(got) > 20
    for key, cells in by_region.items():
        want = walked(cells)
        assert [got[key][k] for k in range(len(want))] == [(v, d / 2, len(v)) for v, d in want]


def test_detections_have_polygons_in_coordinates(spark):
    solid = [(1, r, c, True) for r in range(10, 40) for c in range(5, 25) if not (15 <= r < 20 and 8 <= c < 12) and not (30 <= r < 33 and c == 20)]
    labels = regions.connected_regions(spark.createDataFrame(solid + [(2, 3, 4, True)], "aoi_id int, row int, col int, hit boolean"))
    grids = spark.createDataFrame([(1, 32622, 10.0, -10.0, 500000.0, 400000.0), (2, 32722, 10.0, -10.0, 300000.0, 9000000.0)], "aoi_id int, epsg int, a double, e double, x0g double, y0g double")
    got = {r.aoi_id: r for r in regions.detection_geometry(labels, grids).collect()}
    assert got[1].area_m2 == 100.0 * len(solid) and got[1].n_rings == 3 and got[2].area_m2 == 100.0 and got[2].n_rings == 1
    shape = json.loads(got[1].geometry)
    assert shape["type"] == "Polygon" and [len(r) for r in shape["coordinates"]] == [5, 5, 5] and all(r[0] == r[-1] for r in shape["coordinates"])
    # metres per degree at the zone's centre; shells run counterclockwise, holes clockwise
    lat = shape["coordinates"][0][0][1]
    signed = [sum((a[0] * b[1] - b[0] * a[1]) for a, b in zip(r, r[1:], strict=False)) / 2 * 111319.49 * math.cos(math.radians(lat)) * 110574 for r in shape["coordinates"]]
    assert signed[0] > 0 > max(signed[1:]) and sum(signed) == pytest.approx(got[1].area_m2, rel=0.002)
    assert not regions.detection_geometry(labels.limit(0), grids).count()


def grid_of(spark, values):
    n, m = values.shape
    return spark.createDataFrame([(1, r, c, float(values[r, c])) for r in range(n) for c in range(m)], "aoi_id int, row int, col int, level double")


def test_tiles_give_what_the_whole_grid_gives(spark):
    rng = np.random.default_rng(5)
    x, y = (rng.integers(0, 9000, (53, 47)) for _ in range(2))
    rows = spark.createDataFrame([(1, r, c, int(x[r, c]), int(y[r, c])) for r in range(53) for c in range(47)], "aoi_id int, row int, col int, x int, y int")
    whole = tiles.ssim_dissimilarity(x, y)
    for side in (16, 20, 256):
        found = tiles.over_tiles(rows, {"s": "double"}, lambda g: {"s": tiles.ssim_dissimilarity(g.of("x", 0, np.int64), g.of("y", 0, np.int64))}, 3, side=side).collect()
        assert len(found) == 53 * 47 and all(r.s == whole[r.row, r.col] for r in found)
    plain = np.array([[1 - _ssim_at(x, y, r, c) for c in range(47)] for r in range(0, 53, 7)])
    assert np.allclose(plain, whole[::7])


def _ssim_at(x, y, r, c):
    a, b = (np.pad(v, 3, mode="symmetric")[r : r + 7, c : c + 7].astype(float) for v in (x, y))
    cov = ((a - a.mean()) * (b - b.mean())).sum() / 48
    return (2 * a.mean() * b.mean() + 1e4) * (2 * cov + 9e4) / ((a.mean() ** 2 + b.mean() ** 2 + 1e4) * (a.var(ddof=1) + b.var(ddof=1) + 9e4))


def test_levels_serve_every_threshold(spark):
    rng = np.random.default_rng(2)
    values = np.kron(rng.random((20, 20)), np.ones((2, 2))) * rng.choice([1, 1, 1, 0.2], (40, 40))
    frame = grid_of(spark, values)
    levels = {(r.row, r.col): r.level for r in pixels.clean_levels(frame, "level").collect()}
    for t in (0.1, 0.3, 0.5, 0.8):
        mask = pixels.clean_mask(frame.select("aoi_id", "row", "col", (F.col("level") >= t).alias("hit"))).collect()
        byrows = pixels.binary_erosion(pixels.binary_dilation(pixels.binary_dilation(pixels.binary_erosion(frame.select("aoi_id", "row", "col", (F.col("level") >= t).alias("hit")))))).collect()
        want = {(r.row, r.col): r.hit for r in byrows}
        assert {(r.row, r.col): r.hit for r in mask} == want == {k: v is not None and v >= t for k, v in levels.items()}


def test_ssim_only_where_a_rule_needs_it(spark, sf):
    from groundshift.sources.fixtures import table

    pairs = table(spark, sf, "pixels")
    all_, some = (pixels.cleaned_maps(pairs, ssim_everywhere=e) for e in (True, False))
    keys = ["aoi_id", "row", "col"]
    assert some.where("vertical <> 0 and ssim_dissim is not null or vertical = 0 and ssim_dissim is null").count() == 0
    assert all_.select(*keys, "hit").exceptAll(some.select(*keys, "hit")).count() == 0


def test_ring_helpers_on_nothing(spark):
    none = spark.createDataFrame([], "aoi_id int, region_id long, r0 int, c0 int, r1 int, c1 int")
    assert R.region_rings(none).count() == 0 and R.region_polygons(none).count() == 0
