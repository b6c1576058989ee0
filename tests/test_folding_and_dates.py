"""Folding of any script, both dates' classes, the band of SSIM, and any number of watches."""

import unicodedata

from pyspark.sql import functions as F
from test_operators import found, scene_pair

from groundshift.functions import columns as C
from groundshift.operators import articles as A
from groundshift.operators import pixels, regions, scoring
from groundshift.operators.presets import PRESETS, Preset, Rule
from groundshift.sources.fixtures import table


def folded(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.casefold().split())


def test_normalising_follows_the_rule_in_any_script(spark):
    texts = ["Việt Nam", "Αθήνα ΣΑΣ", "ﬁne ﬂood ½ ㎢", "Край  ЙОД", "Straße ẞ", "İstanbul", "ｆｕｌｌ　ｗｉｄｔｈ", "हिन्दी कि", "𝔉raktur 𝟙", "a b c\x85d", "ȩ́", "", " \t ", "①②", "x" * 100_000 + "É"]
    texts += [chr(c) + "a" for c in range(0x20, 0x3000, 7)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", C.normalize_text(F.col("t")).alias("n")).collect()
    wrong = [(r.t, r.n) for r in rows if r.n != (None if r.t is None else folded(r.t))]
    assert not wrong
    met = spark.createDataFrame([("Nach Việt Nam, Ἀθῆναι",)], "t string").select(C.match_terms(F.col("t"), F.array(F.lit("viet nam"), F.lit("Αθηναι"), F.lit("Viet N"))).alias("m")).first()
    assert met.m == ["viet nam", "Αθηναι"]


def test_a_cloud_on_either_date_hides_a_pixel(spark):
    pairs = scene_pair(spark, "forest", "bare", [(20, 20, 10, 20)], vertical=1)
    two = pairs.withColumns({"scl0": F.when(F.col("row") < 25, 9).otherwise(4), "scl1": F.when(F.col("col") < 30, 8).otherwise(4)})
    maps = pixels.change_maps(two, classes=("scl0", "scl1"))
    assert maps.where("usable").count() == 35 * 30 and maps.where("usable is null").count() == 0
    kept = regions.detect_changes(two, classes=("scl0", "scl1"))[0].collect()
    assert [r["n_pixels"] for r in kept] == [50] and [r["n_pixels"] for r in found(two)] == [200]
    assert scoring.valid_pixels(two.withColumn("scl1", F.lit(None).cast("int")), ("scl0", "scl1")).where("valid").count() == 0


def test_ssim_is_taken_of_the_presets_band(spark):
    pairs = scene_pair(spark, "bare", "bare", [], vertical=0).withColumn("nir1", F.when(F.col("row").between(20, 39) & F.col("col").between(20, 39), (F.col("row") * 37 + F.col("col") * 91) % 3000).otherwise(F.col("nir1")))
    by = lambda band: (Preset("port", "construction", (Rule("ssim_dissim", "increase", 0.55),), "ssim_dissim", 5000.0, ssim_band=band), *PRESETS[1:])
    assert not found(pairs, by("red")) and len(found(pairs, by("nir"))) == 1
    mixed = (by("nir")[0], Preset("other", "construction", (Rule("ssim_dissim", "increase", 0.55),), "ssim_dissim", 5000.0))
    assert len(found(pairs, mixed)) == 1 and not found(pairs.withColumn("vertical", F.lit(1)), mixed)


def test_more_watches_than_one_broadcast_score_the_same(spark, sf, monkeypatch):
    articles = table(spark, sf, "articles")
    watches = spark.range(7).selectExpr("cast(id as int) aoi_id", "array('The', 'Für') place_terms", "cast(array() as array<string>) region_terms", "array('er', 'ing') stems", "array('English', 'German') languages",
                                        "timestamp'2023-06-01 00:00:00' window_start", "timestamp'2024-06-01 00:00:00' window_end")
    rows = lambda df: sorted((r.aoi_id, r.article_id, r.reason or "") for r in df.select("aoi_id", "article_id", "gate.reason").collect())
    one = rows(A.score_articles(articles, watches))
    monkeypatch.setattr(A, "WATCHES_BROADCAST", 2)
    assert len(one) == 7 * articles.count() and rows(A.score_articles(articles, watches)) == one
    assert not A.score_articles(articles.limit(0), watches).count()
