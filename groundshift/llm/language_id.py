"""Language identification: known words first, shorter and shorter character n-grams otherwise.

The model holds log frequencies per language: of the most frequent words, and of character
n-grams of each length. A word outside the word list is scored by its known n-grams of the greatest
length that has any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .shingles import chunks

#: Bounds of the model. The training sample is chosen by a hash of the text and holds about this
#: many different texts of each language; statistics are over their whole texts. Words and n-grams stay in the
#: model if they make up MIN_SHARE of a language's, so there are at most 1 / MIN_SHARE of each kind and language.
TRAIN_DOCS = 5_000
MIN_SHARE = 2e-5
#: Scored words that a Python worker remembers; beyond it starts anew.
CACHE_WORDS = 100_000
NGRAMS = (4, 3, 2, 1)
SMOOTH = 0.5
UNDETERMINED = "und"
#: Score below which the filter rejects a document.
MIN_SCORE = 0.5
#: A word speaks for the languages in which it is at most this many times rarer than in its own.
RARER = 20
#: The score is MIN_SCORE where this share of the way from words of other languages to words of its
#: own is covered: a document with fewer words of one language than that is rejected. The ends of the
#: way are medians over one in CALIBRATION of the training sample, which the frequencies leave out.
COVERED = 0.65
CALIBRATION = 10
_WORD = r"\p{L}[\p{L}\p{M}]*"


@dataclass
class Model:
    """Log frequencies in each language of known words (length 0) and n-grams (their length).

    ``index[k]`` gives a word's or n-gram's row in ``logs[k]``, which has a column per language, and in
    ``speaks[k]``, whether it speaks for each. ``least`` is the evidence a word at which the score is MIN_SCORE.
    """

    languages: list[str]
    index: dict[int, dict[str, int]]
    logs: dict[int, np.ndarray]
    speaks: dict[int, np.ndarray]
    least: float = MIN_SCORE

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.known = dict(self.index[0])
        self.scores = np.concatenate((self.logs[0], self.speaks[0]), axis=1)

    def _back_off(self, words: list[str]) -> np.ndarray:
        """Mean log frequency of each word's n-grams of the greatest length that has known ones, then
        the share of its n-grams of the greatest length that it has that speaks for each language."""
        width = len(self.languages)
        out = np.zeros((len(words), 2 * width))
        todo = list(range(len(words)))
        for n in NGRAMS:
            get, rows, sizes, done, rest, pieces = self.index[n].get, [], [], [], [], []
            for i in todo:
                w = f" {words[i]} "
                hits = [r for j in range(len(w) - n + 1) if (r := get(w[j : j + n])) is not None]
                if hits:
                    rows += hits
                    sizes.append(len(hits))
                    done.append(i)
                    pieces.append(len(w) - n + 1 if n == min(len(w), NGRAMS[0]) else 0)
                else:
                    rest.append(i)
            if done:
                size = np.array(sizes)
                starts = np.cumsum(size) - size
                out[done, :width] = np.add.reduceat(self.logs[n][rows], starts) / size[:, None]
                whole = np.array(pieces)[:, None]  # none where only shorter n-grams are known
                share = np.add.reduceat(self.speaks[n][rows].astype(float), starts) / np.maximum(whole, 1)
                out[done, width:] = np.where(whole > 0, share, 0)
            todo = rest
        return out

    def evidence(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Summed log frequency in each language, then the mean share of a word that speaks for each."""
        split = [regex.findall(_WORD, (t or "").lower()) for t in texts]
        if len(self.known) > CACHE_WORDS + len(self.index[0]):
            self.forget()
        fresh = list({w for words in split for w in words if w not in self.known})
        if fresh:
            self.known.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh)), strict=True))
            self.scores = np.concatenate((self.scores, self._back_off(fresh)))
        get, out = self.known.__getitem__, []
        for words in split:
            if not words or not self.languages:
                out.append(None)
                continue
            total = self.scores[np.fromiter(map(get, words), dtype=np.int64, count=len(words))].sum(axis=0)
            total[len(self.languages) :] /= len(words)
            out.append(total)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Most likely language and a score; und and 0 without letters.

        The score is the lesser of the language's share of the likelihood and of what its words
        speak for it, where ``least`` a word is MIN_SCORE, 0 is 0, 1 is 1, and lines lie between.
        """
        out, width = [], len(self.languages)
        for total in self.evidence(texts):
            if total is None:
                out.append((UNDETERMINED, 0.0))
                continue
            share = np.exp(total[:width] - total[:width].max())
            best = int(share.argmax())
            spoken = float(np.interp(total[width + best], (0.0, self.least, 1.0), (0.0, MIN_SCORE, 1.0)))
            out.append((self.languages[best], min(float(share[best] / share.sum()), spoken)))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, counts: dict[str, int], train_docs: int = TRAIN_DOCS) -> DataFrame:
    """text and lang of about ``train_docs`` different texts of each language, all if there are no more; ``counts`` says how many different ones each has.

    A share of the 63-bit hashes of texts: it is never empty for want of precision or for copies, which count once.
    """
    shares = [x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min((1 << 63) - 1, (1 << 63) * train_docs // max(n, 1))))]
    if not shares:
        return docs.select("text", "lang").limit(0)
    h = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    return docs.select("text", "lang").where(h <= F.element_at(F.create_map(*shares), F.col("lang"))).distinct()


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_share: float = MIN_SHARE) -> Model:
    """Fit a model on documents with a language that are not held out, by text and lang alone.

    The sample is bounded by ``train_docs`` a language, the model by ``min_share``; the driver holds the
    model. One document in ``CALIBRATION`` of the sample, chosen by a hash of the text, gives no
    frequencies but the least evidence a word of a clean document. Any string may name a language; the
    plan has a column for each, so there should be hundreds at most.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    labelled = materialize(training_sample(labelled, counts, train_docs), "lang-sample")
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "text"), F.lit(CALIBRATION)) == 0
    labelled, aside = labelled.where(~apart), labelled.where(apart)
    found = F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))
    words = labelled.select("lang", F.explode(found).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"))
    words = materialize(words, "lang-words")
    padded = F.concat(F.lit(" "), F.col("g"), F.lit(" "))
    pieces = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - k + 1, F.lit(1))), lambda i, k=k: F.struct(F.lit(k).alias("k"), F.substring(padded, i, F.lit(k)).alias("g"))) for k in NGRAMS]))
    grams = words.select("lang", "n", F.explode(pieces).alias("p")).groupBy("lang", "p.k", "p.g").agg(F.sum("n").alias("n"))
    every = materialize(words.select("lang", F.lit(0).alias("k"), "g", "n").unionByName(grams.select("lang", "k", "g", "n")), "lang-grams")
    totals = {(r["lang"], r["k"]): r["n"] for r in every.groupBy("lang", "k").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for lang, _ in totals})
    kinds = (0, *NGRAMS)
    sums = {k: np.array([float(totals.get((lang, k), 0)) for lang in languages]) for k in kinds}
    index, logs, speaks = {k: {} for k in kinds}, {k: np.zeros((0, len(languages))) for k in kinds}, {k: np.zeros((0, len(languages)), bool) for k in kinds}
    if languages:
        # columns go by the number of the language: names may be any string
        numbered = every.withColumn("li", F.array_position(F.array(*[F.lit(lang) for lang in languages]), F.col("lang")))
        names = [f"n{i}" for i in range(1, len(languages) + 1)]
        share = numbered.groupBy("k", "g").agg(*[F.coalesce(F.sum(F.when(F.col("li") == i, F.col("n"))), F.lit(0)).alias(name) for i, name in enumerate(names, 1)])
        least = lambda lang: F.element_at(F.create_map(*[x for k in kinds for x in (F.lit(k), F.lit(max(1.0, min_share * float(totals.get((lang, k), 0)))))]), F.col("k"))
        kept = F.lit(False)
        for lang, name in zip(languages, names, strict=True):
            kept = kept | (F.col(name) >= least(lang))
        best = share.where(kept).toArrow()
        ks, gs = best.column("k").to_numpy(), best.column("g").to_pylist()
        counts = np.stack([best.column(name).to_numpy().astype(float) for name in names], axis=1)
        for k in kinds:
            rows = np.flatnonzero(ks == k)
            index[k] = {gs[r]: i for i, r in enumerate(rows)}
            logs[k] = np.log((counts[rows] + SMOOTH) / (sums[k] + SMOOTH * (len(rows) + 1)))
            speaks[k] = (counts[rows] > 0) & (logs[k] >= logs[k].max(axis=1, keepdims=True, initial=-np.inf) - np.log(RARER))
    model = Model(languages, index, logs, speaks)
    model.least = _least_evidence(model, aside) or model.least
    return model


_EVIDENCE = "own double, other double"


def _least_evidence(model: Model, aside: DataFrame) -> float | None:
    """Evidence a word that is ``COVERED`` of the way from other languages to the own; null without documents."""
    shared = aside.sparkSession.sparkContext.broadcast((model.languages, model.index, model.logs, model.speaks))

    def run(batches):
        local = Model(*shared.value)
        width = len(local.languages)
        for batch in small_batches(batches):
            texts, langs, own, other = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for a, b in chunks(texts):
                for lang, total in zip(langs[a:b], local.evidence(texts[a:b]), strict=True):
                    if total is not None and lang in local.languages:
                        spoken, at = total[width:], local.languages.index(lang)
                        own.append(float(spoken[at]))
                        other.append(float((spoken.sum() - spoken[at]) / (width - 1)) if width > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.float64()), pa.array(other, pa.float64())], names=["own", "other"])

    own, other = aside.mapInArrow(run, _EVIDENCE).agg(F.percentile_approx("own", 0.5), F.percentile_approx("other", 0.5)).first()
    if own is None or not other < own:
        return None
    return min(max(other + COVERED * (own - other), 1e-6), 1 - 1e-6)


_PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every whole text.

    The score is at least ``MIN_SCORE`` where the text's words speak for the language as those of
    labelled documents do (see ``Model.predict``), whatever the text's length.
    A null text or one without letters is ``und`` with score 0; so is every text if nothing can be
    learned. A null doc_id is carried along and never held out; repeated rows stay, other columns
    are ignored. ``lang``, ``source`` and ``doc_id`` are no inputs of a prediction.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.index, model.logs, model.speaks, model.least))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        local = Model(*shared.value)
        for batch in small_batches(batches):
            texts = batch.column(2).to_pylist()
            found = [one for a, b in chunks(texts) for one in local.predict(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, _PREDICTED)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all columns: a score of at least ``MIN_SCORE``."""
    model = model or train(docs)
    shared, at = docs.sparkSession.sparkContext.broadcast((model.languages, model.index, model.logs, model.speaks, model.least)), docs.columns.index("text")

    def run(batches):
        local = Model(*shared.value)
        for batch in small_batches(batches):
            texts = batch.column(at).to_pylist()
            stay = [lang != UNDETERMINED and score >= MIN_SCORE for a, b in chunks(texts) for lang, score in local.predict(texts[a:b])]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
