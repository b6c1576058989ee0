"""The language filter on texts that are of no known language, or of several."""

import random

import pytest
from pyspark.sql import functions as F

from groundshift.llm import language_id


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [(r["lang"], r["text"]) for r in docs.where(language_id.held_out(F.col("doc_id"))).select("lang", "text").collect()]
    return language_id.train(docs), held


def rejected(model, texts):
    return sum(score < language_id.MIN_SCORE for _, score in model.predict(texts)) / len(texts)


def test_clean_texts_pass(parts):
    model, held = parts
    assert rejected(model, [t for _, t in held]) < 0.02


@pytest.mark.parametrize("words", [20, 200, 2000])
def test_gibberish_is_rejected_at_any_length(parts, words):
    rnd = random.Random(words)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 10)))
    assert rejected(parts[0], [" ".join(word() for _ in range(words)) for _ in range(50)]) == 1


def test_mixed_texts_are_rejected(parts):
    model, held = parts
    rnd, by = random.Random(4), {}
    for lang, text in held:
        if len(text.split()) >= 60:
            by.setdefault(lang, []).append(text)
    mixes = [" ".join(w for texts in by.values() for w in rnd.choice(texts).split()[:50]) for _ in range(50)]
    assert len(by) == 4 and rejected(model, mixes) > 0.95
