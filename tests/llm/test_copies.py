"""Corpora of few texts in many copies, and rows repeated many times."""

import random

from pyspark.sql import functions as F

from groundshift.llm import language_id, near_join, quality

GOOD = ["The committee met on the second day of March and agreed on a plan, which the council will publish before the summer begins. Members asked how the work would be paid for and who would carry it out.",
        "Rain fell over the valley for most of the night, and by morning the river had reached the lower road. Farmers moved their cattle to the hills, while the bridge stayed open until noon.",
        "She wrote to her brother about the harvest, the new school and the price of bread. He answered in a long letter that she kept in a drawer, next to the photographs of the old house."]
JUNK = ["$$ @@ ## " * 12, "BUY NOW!!! BUY NOW!!! " * 14]


def copies(spark, n):
    texts = GOOD + JUNK
    rows = spark.range(n + 200)
    at = F.when(F.col("id") < n, F.pmod("id", F.lit(3))).otherwise(3 + F.pmod("id", F.lit(2)))
    return rows.select(F.col("id").alias("doc_id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (at + 1).cast("int")).alias("text"), F.when(F.col("id") < n, "en").alias("lang"))


def test_few_texts_in_many_copies_are_learned(spark):
    docs = copies(spark, 100_000).cache()
    different = 5
    assert quality.training_sample(docs, different).count() == different
    keep = {(r["text"], r["keep"]) for r in quality.score_documents(docs).join(docs, "doc_id").select("text", "keep").distinct().collect()}
    assert keep == {(t, True) for t in GOOD} | {(t, False) for t in JUNK}
    found = language_id.identify(docs).where("doc_id < 100000").groupBy("lang_pred").count().collect()
    assert [(r["lang_pred"], r["count"]) for r in found] == [("en", 100_000)]


def test_samples_have_a_lower_bound(spark):
    """Half of the rows copies of one text: as many different ones are sampled as are wanted."""
    frame = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("one hot text of all")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    assert quality.training_sample(frame, 20_001, 1000).count() == 1000
    assert 900 < language_id.training_sample(frame, {"en": 20_001}, 1000).count() < 1100


def test_repeated_rows_are_compared_once(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(60)]
    text, near, far = " ".join(words), " ".join(words[:56]), " ".join(reversed(words))
    rows = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(8, near), (8, near), (9, far)], rows.schema))
    got = {(r["doc_id"], r["class_id"], r["n_links"]): r["count"] for r in near_join.near_duplicates(docs).groupBy("doc_id", "class_id", "n_links").count().collect()}
    assert got == {(7, 7, 10_001): 10_000, (8, 7, 10_001): 2, (9, 9, 0): 1}


def test_short_texts_meet(spark):
    """Sets of 4 to 10 shingles and others at 0.8 or little more: one taken away or one added."""
    rnd, rows, want = random.Random(11), [], 0
    for i in range(4000):
        n = rnd.randint(4, 10)  # shingles
        words = [f"w{rnd.randrange(10**9)}" for _ in range(n + 4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + ["end"]))]
        want += n / (n + 1) >= 0.8
    got = near_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_links")).first()[0]
    assert want == 4000 and got >= 2 * (want - 2)


def test_probes_are_at_the_similarity(spark):
    import numpy as np

    for n in range(1, 60):
        one = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        probe = near_join._probe(one, 0.8)
        if n < 4:
            assert probe is None
        else:
            both = len(np.intersect1d(one, probe))
            like = both / (len(one) + len(probe) - both)
            assert 0.8 <= like < 0.86 and len(np.unique(probe)) == len(probe)


def test_every_text_is_probed(spark):
    """The depths come of all texts: on more than 20,000 of them (as many as were probed before) each different one has its probe."""
    rows = spark.range(21_000).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(0, 9), x -> concat('w', id, '_', x))) text")
    caught, take = [], near_join.measured_depths
    near_join.measured_depths = lambda firsts, *a: caught.append(firsts) or take(firsts, *a)
    try:
        assert near_join.near_duplicates(rows).agg(F.sum("n_links")).first()[0] == 0
    finally:
        near_join.measured_depths = take
    assert caught[0].where("shared is not null").count() == caught[0].count() == 21_000


def test_levels_are_those_of_the_whole_probe():
    """Hashing only what changed gives the levels that the probe's own signature gives."""
    import numpy as np

    sets = [near_join.mix(np.arange(n, dtype=np.uint64) + np.uint64(1000 * n)) for n in (4, 5, 7, 9, 30, 31, 500)]
    whole = lambda s: near_join._signatures(np.concatenate(s), np.concatenate(([0], np.cumsum([len(x) for x in s]))), near_join.TREES)
    found, again = whole(sets), whole([near_join._probe(x, 0.8) for x in sets])
    want = np.cumprod((found == again).reshape(len(sets), near_join.TREES, near_join.MAX_DEPTH), axis=2).sum(axis=2)
    assert (near_join._followed(found, [near_join._change(x, 0.8) for x in sets], near_join.TREES) == want).all()
