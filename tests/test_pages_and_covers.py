"""Nested lists in pages, and polygons met by covers of cells."""

import random

from pyspark.sql import functions as F

from groundshift.operators import articles, claims, geometry, ranking


def _sorted_pages(values, size, lead=0):
    values = sorted(values)
    head = values[: size + lead]
    return [head] + [values[i : i + size] for i in range(size + lead, len(values), size)]


def test_pages_equal_sorted_lists(spark):
    """Keys below, at and above a page, a null key, repeated values; one key holds most rows."""
    rnd = random.Random(5)
    rows = [(k, rnd.randint(0, 400)) for k, n in ((1, 3), (2, 10), (3, 11), (4, 3001), (None, 57), (6, 1)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "k int, v int").repartition(5)
    for lead in (0, 1):
        got = {}
        for r in ranking.paged(frame, ["k"], [], F.col("v"), size=10, lead=lead).collect():
            assert r.first == min(v for k, v in rows if k == r.k) and (r.k, r.page) not in got
            got[r.k, r.page] = r["items"]
        want = {(k, i): p for k in {k for k, _ in rows} for i, p in enumerate(_sorted_pages([v for key, v in rows if key == k], 10, lead))}
        assert got == want
    assert ranking.paged(frame.limit(0), ["k"], [], F.col("v")).count() == 0


def test_duplicates_of_a_frequent_title(spark):
    """One title of 60 articles (ties of rank and time, a null domain), one of its own, one without a title: pages in order, one survivor."""
    rnd = random.Random(9)
    rows = [(1, i, f"u{i}", "Dam breaks!", rnd.choice(["a", "b", "c", None]), f"2024-01-{rnd.randint(1, 5):02d}") for i in range(60)]
    rows += [(1, 70, "u70", "Quiet day", "a", "2024-01-01"), (1, 71, "u71", None, "b", None)]
    frame = spark.createDataFrame(rows, "aoi_id int, article_id long, url string, title string, domain string, day string").withColumn("seendate", F.to_timestamp("day"))
    ranks = spark.createDataFrame([("a", 1), ("b", 0)], "domain string, domain_rank int")
    got = {}
    for r in articles.dedupe_articles(frame, ranks, page_size=7).collect():
        got.setdefault(r.title_key, {})[r.page] = (r.article_id, r.duplicates)
    order = sorted(rows[:60], key=lambda r: ({"a": 1, "b": 0}.get(r[4], 1 << 30), r[5], r[1]))
    pages = got["dam breaks"]
    assert {p[0] for p in pages.values()} == {order[0][1]} and len(pages) == 9
    assert [u for i in range(9) for u in pages[i][1]] == [r[2] for r in order[1:]] and all(len(p[1]) <= 7 for p in pages.values())
    assert got["quiet day"] == {0: (70, [])} and got[None] == {0: (71, [])}


def test_evidence_in_pages(spark):
    """A detection that many claims cite, a claim that cites many, repeated and unknown ids, a claim without any."""
    links = [(c, 7) for c in range(25)] * 2 + [(3, d) for d in range(40)] + [(99, 1000), (98, None)]
    frame = spark.createDataFrame(links, "claim_id long, detection_id long")
    known = spark.createDataFrame([(d,) for d in range(30)], "detection_id long")
    by_claim, by_detection = claims.evidence_index(frame, known, page_size=10)
    a = {(r.claim_id, r.page): r.detections for r in by_claim.collect()}
    assert [a[3, i] for i in range(3)] == [list(range(0, 10)), list(range(10, 20)), list(range(20, 30))]
    assert a[99, 0] == a[98, 0] == [] and a[0, 0] == [7] and len(a) == 24 + 3 + 2
    b = {(r.detection_id, r.page): r.claims for r in by_detection.collect()}
    assert [b[7, i] for i in range(3)] == [list(range(10)), list(range(10, 20)), list(range(20, 25))] and b[0, 0] == [3]


def _ring(aoi, polygon, points):
    return [(aoi, polygon, *a, *b) for a, b in zip(points, points[1:] + points[:1])]


def _star(rnd, x, y, size):
    from math import cos, pi, sin

    radii = [size * rnd.uniform(0.4, 1.0) for _ in range(9)]
    return [(x + r * cos(2 * pi * i / 9), y + r * sin(2 * pi * i / 9)) for i, r in enumerate(radii)]


EDGES = "aoi_id int, polygon int, x0 double, y0 double, x1 double, y1 double"


def test_regions_under_covers_equal_pixels(spark):
    """Large and small polygons that overlap: the same regions as by comparing all of their pixels."""
    rnd = random.Random(2)
    edges = [e for k, (x, y, s) in enumerate([(200, 200, 190), (260, 220, 60), (30, 400, 9), (390.5, 390.5, 0.3), (-20, -20, 45)]) for e in _ring(1, k, _star(rnd, x, y, s))]
    edges += _ring(2, 0, [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)]) + [(3, 0, 1.0, 1.0, None, 2.0)]
    frame = spark.createDataFrame(edges, EDGES)
    labels = [(a, r, c, r // 3 * 1000 + c // 3) for a in (1, 2, 3) for r in range(0, 450) for c in range(rnd.randrange(7), 450, 7)]
    pixels = spark.createDataFrame(labels, "aoi_id int, row int, col int, region_id long")
    cells = {tuple(r) for r in geometry.rasterize_polygons(frame).union(geometry.touched_cells(frame)).collect()}
    want = {(a, k) for a, r, c, k in labels if (a, r, c) in cells}
    got = geometry.intersects_filter(pixels, frame).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 1000
    inner, border = geometry.cover(frame)
    large = inner.where("aoi_id = 1").groupBy("level").count().collect()
    assert len(large) == 2 and sum(r["count"] << (2 * r.level) for r in large) > 0.5 * len({c for c in cells if c[0] == 1 and c[1] >= 0 and c[2] >= 0})
    assert geometry.intersects_filter(pixels.limit(0), frame).count() == geometry.intersects_filter(pixels, frame.limit(0)).count() == 0


def test_windows_of_any_size_meet_polygons(spark):
    """Boxes and polygons over nine orders of magnitude, several windows an area, touching sides, holes of nothing: equal to testing all pairs."""
    rnd = random.Random(4)
    polygons, edges, windows = {}, [], []
    for k in range(120):
        a, size = rnd.choice([1, 1, 1, 2]), 10 ** rnd.uniform(-4, 4)
        ring = _star(rnd, rnd.uniform(-2000, 2000), rnd.uniform(-2000, 2000), size)
        polygons[a, k] = ring
        edges += _ring(a, k, ring)
    polygons[1, 500] = [(0.0, 0.0), (16.0, 0.0), (16.0, 16.0), (0.0, 16.0)]
    edges += _ring(1, 500, polygons[1, 500]) + [(1, 501, None, 0.0, 1.0, 1.0), (None, 502, 0.0, 0.0, 1.0, 1.0)]
    windows = [(1, 16.0, 16.0, 20.0, 20.0), (1, 5.0, 5.0, 5.0, 5.0), (1, None, 0.0, 1.0, 1.0)]
    for _ in range(60):
        x, y, w, h = rnd.uniform(-2500, 2500), rnd.uniform(-2500, 2500), 10 ** rnd.uniform(-4, 3), 10 ** rnd.uniform(-4, 3)
        windows.append((rnd.choice([1, 2, 3]), x, y, x + w, y + h))
    w = spark.createDataFrame(windows, "aoi_id int, wminx double, wminy double, wmaxx double, wmaxy double")

    def meets(ring, box):
        x0, y0, x1, y1 = box
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            lo, hi = 0.0, 1.0
            for p, d, u, v in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
                if d == 0:
                    lo, hi = (lo, hi) if u <= p <= v else (2.0, -1.0)
                else:
                    s, t = sorted(((u - p) / d, (v - p) / d))
                    lo, hi = max(lo, s), min(hi, t)
            if lo <= hi:
                return True
            if (ay > y0) != (by > y0) and x0 < ax + (y0 - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    want = {(a, k) for (a, k), ring in polygons.items() if any(b[0] == a and b[1] is not None and meets(ring, b[1:]) for b in windows)}
    got = geometry.truth_in_window(spark.createDataFrame(edges, EDGES), w).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
