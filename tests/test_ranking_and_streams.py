"""Places and percentiles without single tasks, nearness by distance transform, contexts of briefs, keyed streams."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundshift.operators import articles as A
from groundshift.operators import claims, pixels, ranking, regions, scenes
from groundshift.plans import queries_articles as QA
from groundshift.sources.fixtures import table
from groundshift.streaming import updates


def test_places_equal_a_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.randint(0, 50), i) for i in range(5000)]
    frame = spark.createDataFrame(rows, "k int, v int, id int").withColumn("place", F.lit("clash")).drop("place").repartition(7)
    got = ranking.placed(frame, ["k"], [F.desc("v"), F.col("id")])
    want = frame.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    whole = ranking.placed(frame, [], [F.col("id")]).collect()
    assert all(r.place == r.id + 1 for r in whole)
    assert ranking.placed(frame.limit(0), ["k"], [F.col("v")]).count() == 0


def test_percentiles_equal_sorting(spark):
    rng = np.random.default_rng(3)
    values = {1: rng.normal(size=4001), 2: rng.integers(0, 10_000, 3000).astype(float), 3: np.full(500, 7.0), 4: np.array([1e-300, 1e300, 5.0]), 5: np.array([2.5])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(1, None), (2, float("nan")), (6, None)]
    frame = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {r.k: r for r in ranking.order_statistics(frame, ["k"], "v", [0.0, 0.02, 0.5, 0.98, 1.0]).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for k, vs in values.items():
        want = np.percentile(vs, [0, 2, 50, 98, 100])
        assert np.allclose([got[k][f"q{i}"] for i in range(5)], want, rtol=1e-12)


def test_levels_of_bands_without_values(spark):
    rows = spark.createDataFrame([(1, 0, 0, "red", None), (1, 0, 1, "red", None), (1, 0, 0, "nir", 3.0), (1, 0, 1, "nir", 9.0)], "aoi_id int, row int, col int, band string, value double")
    got = {(r.band, r.col): r.level for r in pixels.percentile_stretch(rows, 0, 100).collect()}
    assert got == {("red", 0): 0, ("red", 1): 0, ("nir", 0): 0, ("nir", 1): 255}


def test_nearness_equals_all_pairs_of_pixels(spark):
    rnd = random.Random(8)
    cells = {(r, c) for r in range(300) for c in range(300) if rnd.random() < 0.0008}
    cells |= {(r + dr, c + dc) for r, c in list(cells) for dr in range(2) for dc in range(3)} | {(r, c) for r in range(140, 150) for c in range(140, 152)}
    labels = regions.connected_regions(spark.createDataFrame([(1, r, c, True) for r, c in cells], "aoi_id int, row int, col int, hit boolean"))
    by = {}
    for r in labels.collect():
        by.setdefault(r.region_id, []).append((r.row, r.col))
    stats = spark.createDataFrame([(1, k, 0, len(v) * 100.0) for k, v in by.items()], "aoi_id int, region_id long, vertical int, area_m2 double")
    anchor = max(by, key=lambda k: (len(by[k]), -k))

    def gap(a, b):
        return min(10 * (max(0, abs(r - x) - 1) ** 2 + max(0, abs(c - y) - 1) ** 2) ** 0.5 for r, c in a for x, y in b)

    from dataclasses import replace

    from groundshift.operators.presets import PRESETS

    for radius in (300.0, 705.0):
        near = (replace(PRESETS[0], focus_radius_m=radius), *PRESETS[1:])
        got = {r.region_id for r in regions.keep_near_largest(stats, labels, near).collect()}
        assert got == {k for k, v in by.items() if gap(v, by[anchor]) <= radius} and anchor in got and len(got) < len(by)


def test_a_brief_sees_its_pair_and_its_areas_articles(spark):
    detections = spark.createDataFrame([(i, 1, 7, 8, "flooding" if i % 3 else "construction", 100.0 * (i % 60), 0.25, 0.5) for i in range(70)] + [(900, 1, 7, 9, "flooding", 5.0, 0.1, 1.0)],
                                       "detection_id long, aoi_id int, before_scene_id int, after_scene_id int, change_type string, area_m2 double, magnitude double, confidence double")
    articles = spark.createDataFrame([(i, 1, f"2024-01-{28 - i:02d} 10:00:00", f"src{i}", f"Title {i}") for i in range(12)], "article_id long, aoi_id int, seendate string, domain string, title string").withColumn("seendate", F.col("seendate").cast("timestamp"))
    briefs = spark.createDataFrame([(1, 1, 7, 8), (2, 1, 7, 8), (3, 1, 7, 9), (4, 2, 7, 8)], "brief_id long, aoi_id int, before_scene_id int, after_scene_id int").withColumn("n", F.lit("clash")).withColumn("lines", F.lit("clash"))
    got = {r.brief_id: r for r in claims.brief_context(briefs, detections, articles).collect()}
    assert (got[1].n, got[1].total_area, got[1].by_type) == (70, sum(100.0 * (i % 60) for i in range(70)), "construction=24, flooding=46")
    lines = got[1].lines.split("\n")
    assert len(lines) == 50 and lines[0] == "id=59 type=flooding area_m2=5900 magnitude=0.250 confidence=0.50"
    assert got[1].article_lines.split("\n")[0] == "[11] 2024-01-17T10:00:00 src11: Title 11" and len(got[1].article_lines.split("\n")) == 10 and got[1].n_articles == 12
    assert got[2].lines == got[1].lines and (got[3].n, got[3].n_articles) == (1, 12) and (got[4].n, got[4].lines, got[4].article_lines) == (0, "", "")


def test_streams_go_on_where_they_stopped(spark, sf, tmp_path):
    """Files that come later change only their keys; a row that comes twice counts once; the result equals the batch's."""
    every = table(spark, sf, "articles").repartition(4, "article_id")
    every.write.parquet(str(tmp_path / "all"))
    schema = ", ".join(f"`{n}` {t}" for n, t in every.dtypes)
    watches, ranks = QA._watches(spark, sf), QA._ranks(spark)
    files = sorted((tmp_path / "all").glob("part-*.parquet"))
    (tmp_path / "in").mkdir()
    run = lambda: updates.stream_articles(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), watches, ranks)
    plain = lambda df: sorted((r.aoi_id, r.article_id, tuple(r.toponym), tuple(r.duplicates)) for r in df.collect())
    for f in files[:2]:
        (tmp_path / "in" / f.name).write_bytes(f.read_bytes())
    some = A.fuse_articles(spark.read.schema(schema).parquet(str(tmp_path / "in")), watches, ranks)
    assert plain(run()) == plain(some)
    for f in files[2:]:
        (tmp_path / "in" / f.name).write_bytes(f.read_bytes())
    assert plain(run()) == plain(A.fuse_articles(every, watches, ranks)) == plain(run())


def test_scenes_ask_for_a_recheck(spark, tmp_path):
    rows = [(1, 1, "2024-01-06 10:00:00", 5.0, 0.9), (2, 1, "2024-01-05 10:00:00", 3.0, 0.9), (3, 2, "2024-01-27 10:00:00", 3.0, 0.8), (4, 3, "2024-01-05 10:00:00", 3.0, 0.2)]
    frame = spark.createDataFrame(rows, "scene_id long, aoi_id int, captured_at string, cloud_pct double, usable_fraction double").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    requests = spark.createDataFrame([(a, "2024-01-05", "2024-01-12") for a in (1, 2, 3)], "aoi_id int, start string, end string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes)
    got = {r.aoi_id: r for r in updates.stream_scene_selection(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), requests, "2024-01-28").collect()}
    assert {k: r.scene_id for k, r in got.items()} == {1: 2, 2: 3} == {r.aoi_id: r.scene_id for r in scenes.select_usable_scene(frame, requests).collect()}
    assert str(got[1].before_start) == "2024-01-05" and str(got[1].after_start) == "2024-01-06" and str(got[1].after_end) == "2024-01-28"
    assert got[2].before_start is None and got[2].after_end is None


def test_titles_meet_terms_by_an_index(spark, monkeypatch):
    titles = ["Flooding in New York's port", "new  yorker", "BR-163 deforestation", "São Paulo — strasse", "(US) aid", "Москва и область", None, "", "100% true", "northern new york"]
    watches = spark.createDataFrame([(1, ["New York", "BR-163", "Paulo", "(US)", "Москва", "", "100%"], ["region x", "strasse"], ["flood", "defor", "новост", "aid", "new yo", "обл"])], "aoi_id int, place_terms array<string>, region_terms array<string>, stems array<string>")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)] * 2, "article_id int, title string").crossJoin(F.broadcast(watches))
    from groundshift.functions import columns as C

    want = {(r.article_id, tuple(r.m or ()), tuple(r.s or ())) for r in rows.select("article_id", C.match_terms(F.col("title"), F.concat("place_terms", "region_terms")).alias("m"), C.match_stems(F.col("title"), F.col("stems")).alias("s")).collect()}
    for limit in (100, 0):
        monkeypatch.setattr(A, "TERMS_BROADCAST", limit)
        got = A.term_hits(rows, watches).collect()
        assert len(got) == 20 and {(r.article_id, tuple(r.toponym), tuple(r.thematic)) for r in got} == want
    assert (0, ("New York",), ("flood", "new yo")) in want and (5, ("Москва",), ("обл",)) in want and (8, ("100%",), ()) in want
