"""Operators on small hand-made tables with known results."""

import json

import pytest
from pyspark.sql import functions as F

from groundshift.functions import columns as C
from groundshift.operators import articles as A
from groundshift.operators import claims as V
from groundshift.operators import components, geometry, pixels, regions, scenes, scoring, store
from groundshift.operators.presets import PRESETS, Preset, Rule, override
from groundshift.sources import readers
from groundshift.sources.fixtures import COVERS, table
from groundshift.streaming import updates

BANDS = ("red", "green", "blue", "nir")


def scene_pair(spark, before, after, blocks, side=60, vertical=0, cloud=(), aoi=0):
    """Two dates of a square area; ``blocks`` (row, col, height, width) change from one cover to another."""
    p = spark.range(side * side).selectExpr(f"{aoi} aoi_id", f"cast(id div {side} as int) row", f"cast(id % {side} as int) col", f"{vertical} vertical")
    inside = lambda b: (F.col("row") >= b[0]) & (F.col("row") < b[0] + b[2]) & (F.col("col") >= b[1]) & (F.col("col") < b[1] + b[3])
    changed = F.lit(False)
    for b in blocks:
        changed = changed | inside(b)
    clouded = F.lit(False)
    for b in cloud:
        clouded = clouded | inside(b)
    noise = F.pmod(F.xxhash64("row", "col"), F.lit(61)).cast("int") - 30
    out = {"scl": F.when(clouded, 9).otherwise(4)}
    for i, b in enumerate(BANDS):
        out |= {f"{b}0": F.lit(COVERS[before][i]) + noise, f"{b}1": F.when(changed, COVERS[after][i]).otherwise(COVERS[before][i]) + noise}
    return p.withColumns(out)


def found(pairs, presets=PRESETS):
    return regions.detect_changes(pairs, presets)[0].collect()


def test_cleared_forest_is_one_region(spark):
    (r,) = found(scene_pair(spark, "forest", "bare", [(20, 20, 10, 20)], vertical=1))
    assert r["change_type"] == "vegetation_loss" and r["mean_ndvi"] < -0.3 and r["magnitude"] > 0.4 and r["confidence"] == 1.0
    assert r["area_m2"] == 20_000


def test_flooded_land_is_one_region(spark):
    (r,) = found(scene_pair(spark, "bare", "water", [(20, 20, 10, 20)], vertical=2))
    assert r["mean_ndwi"] > 0.3


def test_small_and_clouded_and_unchanged_areas_give_nothing(spark):
    assert not found(scene_pair(spark, "forest", "bare", [(20, 20, 3, 4)], vertical=1))
    assert not found(scene_pair(spark, "forest", "bare", [(20, 20, 10, 20)], vertical=1, cloud=[(0, 0, 60, 60)]))
    for v in (0, 1, 2):
        assert not found(scene_pair(spark, "forest", "bare", [], vertical=v))


def test_focus_keeps_what_is_near_the_largest(spark):
    near = found(scene_pair(spark, "forest", "built", [(20, 20, 20, 20), (20, 70, 10, 10)], side=100))
    assert len(near) == 2
    far = found(scene_pair(spark, "forest", "built", [(20, 20, 20, 20), (20, 300, 10, 10)], side=320))
    assert len(far) == 1 and far[0]["area_m2"] > 30_000


def test_regions_equal_a_flood_fill(spark):
    side = 40
    grid = spark.range(3 * side * side).selectExpr(f"cast(id div {side * side} as int) aoi_id", f"cast(id % {side * side} div {side} as int) row", f"cast(id % {side} as int) col").withColumn("hit", F.pmod(F.xxhash64("aoi_id", "row", "col"), F.lit(100)) < 58)
    on = {(r["aoi_id"], r["row"], r["col"]) for r in grid.where("hit").collect()}
    label, want = {}, {}
    for p in sorted(on):
        if p in label:
            continue
        todo, members = [p], []
        label[p] = p
        while todo:
            a, r, c = todo.pop()
            members.append((a, r, c))
            for q in ((a, r - 1, c), (a, r + 1, c), (a, r, c - 1), (a, r, c + 1)):
                if q in on and q not in label:
                    label[q] = p
                    todo.append(q)
        for m in members:
            want[m] = (p[1] << 20) | p[2]
    got = {(r["aoi_id"], r["row"], r["col"]): r["region_id"] for r in regions.connected_regions(grid).collect()}
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, j) for j in range(101, 180)] + [(500, 500), (None, 3), (900, 800)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 180)}, 900: 800, 800: 800}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_morphology_order_and_borders(spark):
    full = spark.range(49).selectExpr("0 aoi_id", "cast(id div 7 as int) row", "cast(id % 7 as int) col", "true hit")
    inner = pixels.binary_erosion(full).where("hit").collect()
    assert {(r["row"], r["col"]) for r in inner} == {(i, j) for i in range(1, 6) for j in range(1, 6)}
    some = full.withColumn("hit", F.pmod(F.xxhash64("row", "col"), F.lit(3)) > 0)
    e, m, d = ({(r["row"], r["col"]) for r in df.where("hit").collect()} for df in (pixels.binary_erosion(some), some, pixels.binary_dilation(some)))
    assert e <= m <= d


def test_rings_have_the_pixels_area(spark):
    cells = [(0, 7, r, c) for r in range(4) for c in range(4) if not (r in (1, 2) and c in (1, 2))] + [(1, 8, 0, 0), (1, 8, 0, 1), (1, 8, 1, 1)]
    labels = spark.createDataFrame(cells, "aoi_id int, region_id long, row int, col int")
    rings = regions.region_rings(regions.region_outline(labels)).collect()
    area = {}
    for r in rings:
        area.setdefault(r["region_id"], []).append((r["signed_area"], r["n_vertices"]))
    assert sorted(area[7]) == [(-4.0, 4), (16.0, 4)] and area[8] == [(3.0, 6)]


def test_presets_are_validated():
    with pytest.raises(ValueError):
        Rule("ndvi", "increase", 0)
    with pytest.raises(ValueError):
        Preset("x", "y", (Rule("ndvi", "increase", 0.1),), "ndwi", 1.0)
    with pytest.raises(ValueError):
        override(PRESETS[0], min_area_m2=-1)
    assert override(PRESETS[1], {"ndvi": 0.3}).rules[0].threshold == 0.3


def test_undefined_values_pass_no_rule(spark):
    rows = spark.createDataFrame([(0, 0), (None, 5), (3, 1)], "a int, b int").select(C.ratio(F.col("a"), F.col("b")).alias("v"))
    got = rows.select("v", *[C.passes(F.col("v"), d, 0.1).alias(d) for d in ("increase", "decrease", "at_least", "at_most")]).collect()
    assert [r["v"] for r in got] == [None, None, 0.5]
    assert not any(any(list(r)[1:]) for r in got[:2]) and got[2]["increase"] and not got[2]["at_most"]


def test_normalising_and_terms(spark):
    row = spark.createDataFrame([("  Pará:  A Ĝrande São-Paulo BR-163 straße reflooding deforested",)], "t string").select(
        C.normalize_text(F.col("t")).alias("n"), C.title_key(F.col("t")).alias("k"), C.match_terms(F.col("t"), F.array(*map(F.lit, ("para", "BR-163", "Paul", "", "STRASSE", r"a\Eb")))).alias("m"),
        C.match_stems(F.col("t"), F.array(*map(F.lit, ("deforest", "flood", "Gran")))).alias("s")).first()
    assert row["n"] == "para: a grande sao-paulo br-163 strasse reflooding deforested"
    assert row["k"] == "para a grande sao paulo br 163 strasse reflooding deforested"
    assert row["m"] == ["para", "BR-163", "STRASSE"] and row["s"] == ["deforest", "Gran"]


CLAIMS = [  # text, type, detections, articles, codes
    ("New surface of about 18,200 m² between 2021-02-12 and 2025-02-11.", "observed", [1, 2], [], []),
    ("Roughly 12,500 m² of new surface.", "observed", [1], [], []),
    ("Roughly 50,000 m² of new surface.", "observed", [1], [], ["area_mismatch"]),
    ("About 0.012 km² changed.", "observed", [1, 1], [], []),
    ("Captured on 2021-2-9.", "observed", [1], [], ["date_mismatch"]),
    ("Captured on 2021-2-12.", "observed", [1], [], []),
    ("Captured on 2021-13-45.", "observed", [], [], ["date_mismatch", "unlinked_claim"]),
    ("Captured in January, 2019.", "observed", [1], [], ["date_mismatch"]),
    ("Captured in February 2021 near the hangars 5 hangars.", "observed", [1], [], []),
    ("About 40% of the port.", "context", [99], [99], ["quantified_context_claim"]),
    ("News says so.", "reported", [], [], ["observational_framing_on_reported_claim", "unlinked_reported_claim"]),
    ("Regional news reports 6,500 hectares were cleared.", "reported", [], [7], ["quantified_reported_claim"]),
    ("Satellite imagery confirms it, local media say.", "reported", [], [7], ["observational_framing_on_reported_claim"]),
    ("Both sides.", "mixed", [1], [], ["mixed_claim_missing_side"]),
    ("Both sides, 12,000 m².", "mixed", [1, 50, 50], [7, 8], ["unknown_article_id", "unknown_evidence_id", "unknown_evidence_id"]),
    ("  ", "observed", [], [], ["blank_claim"]),
    ("x", "guess", [], [], ["unsupported_claim_type"]),
    ("Articles are not pixels.", "observed", [1], [7], ["article_evidence_on_observed_claim"]),
]


def test_claims_and_their_violations(spark):
    claims = spark.createDataFrame([(1, i, t, k, d, a) for i, (t, k, d, a, _) in enumerate(CLAIMS)], "brief_id long, seq int, text string, claim_type string, evidence array<bigint>, article_evidence array<bigint>")
    briefs = spark.createDataFrame([(1, "2021-02-12", "2025-02-11"), (2, "2021-02-12", "2025-02-11")], "brief_id long, b string, a string").selectExpr("brief_id", "date(b) before_date", "date(a) after_date")
    known = spark.createDataFrame([(1, 1, 12000.0), (1, 2, 6200.0)], "brief_id long, id long, area_m2 double")
    news = spark.createDataFrame([(1, 7)], "brief_id long, id long")
    got = V.validate_briefs(claims, briefs, known, news).collect()
    assert [r["code"] for r in got if r["brief_id"] == 2] == ["empty_brief"]
    for i, c in enumerate(CLAIMS):
        assert sorted(r["code"] for r in got if r["seq"] == i and r["brief_id"] == 1) == c[4], c[0]


def test_gates_in_order(spark):
    watch = spark.createDataFrame([(0, ["Vizhinjam"], ["Kerala"], ["port", "terminal"], ["English"], "2024-05-01", "2024-06-01")], "aoi_id int, place_terms array<string>, region_terms array<string>, stems array<string>, languages array<string>, before_at string, after_at string")
    watch = A.fusion_window(watch.withColumns({c: F.col(c).cast("timestamp") for c in ("before_at", "after_at")}))
    titles = [("Kerala port opens", "English", "https://a", "2024-06-15", None), ("Kerala port opens", "English", "https://a", "2024-06-16", "temporal"), ("Keralan port", "English", "https://a", "2024-06-01", "toponym"),
              ("Kerala import rises", "English", "https://a", "2024-06-01", "thematic"), ("Kerala port", "Malayalam", "https://a", "2024-06-01", "language"), ("Kerala port", "English", "ftp://a", "2024-06-01", "url")]
    rows = spark.createDataFrame([(i, *t[:4]) for i, t in enumerate(titles)], "article_id int, title string, language string, url string, s string").withColumn("seendate", F.col("s").cast("timestamp"))
    got = {r["article_id"]: r["gate"]["reason"] for r in A.score_articles(rows, watch).collect()}
    assert [got[i] for i in range(len(titles))] == [t[4] for t in titles]


def test_item_files(spark, tmp_path):
    item = {"id": "S2B_43PFK", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-05-01T05:00:00Z", "eo:cloud_cover": 10.5, "proj:code": "EPSG:32643", "s2:processing_baseline": "05.00", "earthsearch:boa_offset_applied": True}, "assets": {"red": {"href": "r"}, "scl": {"href": "s"}, "aot": {"href": "x"}}}
    (tmp_path / "a.json").write_text(json.dumps(item, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"id": "x", "properties": {"eo:cloud_cover": 1.0, "s2:processing_baseline": "04.00"}, "assets": {}}))
    a, b = sorted(readers.scenes_from_items(readers.read_items(spark, str(tmp_path))).collect(), key=lambda r: r["stac_id"])
    assert (a["epsg"], a["dn_offset"], a["assets"], a["error"]) == (32643, 0, {"red": "r", "scl": "s"}, None)
    assert (b["epsg"], b["dn_offset"], b["error"]) == (None, -1000, "no datetime")


def test_article_and_feature_files(spark, tmp_path):
    rows = [{"url": "https://a", "title": " T ", "seendate": "20240615T170000Z", "domain": "a", "language": "English"}, {"url": "https://b", "title": "no date"}, {"title": "no url", "seendate": "20240615T170000Z"}]
    for name, body in (("a", json.dumps({"articles": rows})), ("b", "Please limit requests"), ("c", "{}")):
        (tmp_path / f"{name}.txt").write_text(body)
    (got,) = readers.articles_from_artlist(readers.read_article_lists(spark, str(tmp_path))).collect()
    assert (got["title"], str(got["seendate"])) == ("T", "2024-06-15 17:00:00")
    ring = [[0, 0], [2, 0], [2, 2], [0, 0]]
    folder = tmp_path / "g"
    folder.mkdir()
    (folder / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"aoi_id": "01"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    attributes, edges = readers.truth_from_geojson(readers.read_features(spark, str(folder)).withColumn("source", F.lit(0)))
    assert attributes.first()["properties"] == {"aoi_id": "01"} and edges.count() == 3


def test_replacing_twice_is_replacing_once(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "id int, k int, v string")
    run, new = spark.createDataFrame([(1,), (3,)], "k int"), spark.createDataFrame([(9, 3, "n")], "id int, k int, v string")
    once = store.replace_set(base, new, run)
    twice = store.replace_set(once, new, run)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(3, 2, "c"), (9, 3, "n")]


def test_ratios_of_published_counts(spark):
    rows = [(107371, 75910, 70084, 887326), (0, 0, 0, 5)]
    got = scoring.score_ratios(spark.createDataFrame(rows, "tp long, fp long, fn long, tn long")).collect()
    assert [round(got[0][c], 4) for c in ("precision", "recall", "f1", "iou")] == [0.5858, 0.6051, 0.5953, 0.4238]
    assert [got[1][c] for c in ("precision", "recall", "f1", "iou")] == [0.0] * 4


def test_harmonize_skips_scenes_that_lack_the_offset(spark):
    bands = spark.createDataFrame([(0, 0, 0, "red", 300), (0, 0, 1, "red", 400), (1, 0, 0, "red", 1500), (1, 0, 1, "red", 900), (1, 0, 2, "red", 2500)], "aoi_id int, row int, col int, band string, value int")
    got = scenes.harmonize(bands, spark.createDataFrame([(0, -1000), (1, -1000)], "aoi_id int, dn_offset int")).collect()
    assert sorted((r["aoi_id"], r["value"]) for r in got) == [(0, 300), (0, 400), (1, 0), (1, 500), (1, 1500)]


def test_rasterising_by_centre(spark):
    square = [(0, 0, 0.25, 0.25, 2.25, 0.25), (0, 0, 2.25, 0.25, 2.25, 2.25), (0, 0, 2.25, 2.25, 0.25, 2.25), (0, 0, 0.25, 2.25, 0.25, 0.25)]
    edges = spark.createDataFrame(square, "aoi_id int, polygon int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["row"], r["col"]) for r in geometry.rasterize_polygons(edges).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert geometry.touched_cells(edges).where("row = 2 or col = 2").count() == 5
    assert geometry.rasterize_polygons(edges.limit(0)).count() == 0


def test_coordinates_there_and_back(spark):
    from groundshift.functions.geodesy import to_utm, to_wgs84

    rows = spark.createDataFrame([(-51.2, -30.0, 32722), (76.99, 8.37, 32643), (9.0, 0.0, 32632)], "lon double, lat double, epsg int")
    east, north = to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    moved = rows.withColumns({"x": east, "y": north})
    lon, lat = to_wgs84(F.col("x"), F.col("y"), F.col("epsg"))
    for r in moved.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9
    assert abs(moved.where("epsg = 32632").first()["x"] - 500000) < 1e-6


def test_streamed_scenes_equal_the_batch(spark, sf, tmp_path):
    rows = table(spark, sf, "scenes")
    requests = rows.select("aoi_id").distinct().selectExpr("aoi_id", "date'2024-01-05' start", "date'2024-01-12' end")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    got = updates.stream_scene_selection(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), requests)
    want = scenes.select_usable_scene(rows, requests)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_saving_replaces_only_touched_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "id int, k int")
    store.save_replaced(make([(1, 1), (2, 2)]), path, ["k"])
    store.save_replaced(make([(3, 2), (4, 3)]), path, ["k"])
    assert sorted((r["id"], r["k"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (3, 2), (4, 3)]
