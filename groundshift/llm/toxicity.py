"""Toxicity by a weighted finite-state pattern grammar.

Tokens are read as symbols: insult, threat, target, negation, word of reporting, quotation mark, end of a clause or line,
and other. Small transducers each know one thing: which patterns a negation covers, which are reported or
quoted, which have a target in their clause; insults and threats then turn marked patterns into kinds with weights. Composed, they
are one weighted transducer that runs over a text once; a clause's score is the weight of its path, and the
clauses' scores, by kind, are what a document is judged by.

Words of insult are learned: whole words and beginnings of words that labelled toxic texts have and others lack, by the lower
bound of their log odds. The weights of kinds are fitted on labelled texts kept apart from that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .shingles import chunks

#: The model is fitted on at most so many different labelled texts, toxic and others, those of the least hashes;
#: one in CALIBRATION of them fits the weights of kinds, the others the words.
TOXIC_DOCS, CLEAN_DOCS = 5_000, 10_000
CALIBRATION = 3
#: A word or beginning of LEAST_PREFIX to MOST_PREFIX letters counts if LEAST_DOCS toxic texts, and that share of them, have it, and the lower bound of its log odds is LEAST_WEIGHT.
LEAST_PREFIX, MOST_PREFIX = 3, 7
LEAST_DOCS, LEAST_SHARE, LEAST_WEIGHT = 5, 0.003, 1.0
MOST_TERMS = 20_000
CACHE_WORDS = 200_000
#: Tokens after a negation that it covers.
NEGATION_REACH = 3
SEED_WEIGHT = 2.0
RIDGE = 2.0
THRESHOLD = 0.5

# fixed values: words of four languages
THREATS = "kill murder strangle shoot stab umbringen töten ermorden erwürgen erschießen tuer égorger étrangler assassiner matar asesinar degollar estrangular".split()
TARGETS = "you your yours yourself u ya they them he she him her du dich dir ihr euch sie er ihn tu te toi vous il elle ils elles lui tú ti usted ustedes vosotros él ella ellos ellas".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals ne pas jamais ni nunca jamás tampoco".split()
REPORTS = "said says say told tells called calls wrote writes claimed claims quoted quotes sagte sagt nannte nennt schrieb schreibt zitierte dit disait appelait écrit écrivait dijo dice decía llamó llama escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, CLAUSE, LINE = range(9)
_PATTERNS = (INSULT, THREAT)
#: A symbol's marks are multiples of 16.
NEGATED, REPORTED, AIMED = 16, 32, 64
KINDS = ("plain", "targeted", "threat", "loose", "negated", "reported", "late")
#: Weights of the kinds, which the fit starts from: of a plain insult, one at a target, a threat at one and one at none, any negated, any reported, and of a target after the pattern.
PRIOR_WEIGHTS = (1.0, 1.5, 1.5, 0.1, 0.2, 0.3, 0.5)


@dataclass
class Transducer:
    """Letter to letter and sequential: ``arcs[state, symbol]`` is (next state, symbol written, weight); state 0 starts."""

    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def compose(self, other: Transducer) -> Transducer:
        """What ``other`` makes of what this one writes; pairs of states that are reached, weights added."""
        number, todo, out = {(0, 0): 0}, [(0, 0)], Transducer()
        mine: dict[int, list] = {}
        for (state, symbol), arc in self.arcs.items():
            mine.setdefault(state, []).append((symbol, arc))
        while todo:
            p, q = todo.pop()
            for symbol, (p2, written, w) in mine.get(p, ()):
                if (q, written) not in other.arcs:
                    continue
                q2, last, w2 = other.arcs[q, written]
                if (p2, q2) not in number:
                    number[p2, q2] = len(number)
                    todo.append((p2, q2))
                out.arcs[number[p, q], symbol] = (number[p2, q2], last, w + w2)
        return out


def _every(marks: int) -> list[int]:
    """Symbols that a transducer meets after those that set ``marks``: plain ones and marked patterns."""
    masks = [m for m in range(0, marks + 16, 16) if m & ~marks == 0]
    return [*range(9), *[p + m for p in _PATTERNS for m in masks if m]]


def negation() -> Transducer:
    """State: how many more tokens a negation covers."""
    t = Transducer()
    for left in range(NEGATION_REACH + 1):
        for s in _every(0):
            after = NEGATION_REACH if s == NEGATION else 0 if s in (CLAUSE, LINE) else max(left - 1, 0)
            t.arcs[left, s] = (after, s + NEGATED if left and s in _PATTERNS else s, 0.0)
    return t


def reported() -> Transducer:
    """States: own words, the rest of a clause with a word of reporting, between quotation marks (until the line ends)."""
    own, clause, quote = range(3)
    t = Transducer()
    for state in (own, clause, quote):
        for s in _every(NEGATED):
            after = {QUOTE: own if state == quote else quote, REPORT: quote if state == quote else clause, CLAUSE: quote if state == quote else own, LINE: own}.get(s, state)
            t.arcs[state, s] = (after, s + REPORTED if state != own and s % 16 in _PATTERNS else s, 0.0)
    return t


def targeted() -> Transducer:
    """States: no target in the clause yet, one, a pattern without one; a target that comes late is marked itself."""
    none, one, waiting = range(3)
    t = Transducer()
    for state in (none, one, waiting):
        for s in _every(NEGATED | REPORTED):
            pattern = s % 16 in _PATTERNS
            after = none if s in (CLAUSE, LINE) else one if s == TARGET or state == one else waiting if pattern else state
            marked = (pattern and state == one) or (s == TARGET and state == waiting)
            t.arcs[state, s] = (after, s + AIMED if marked else s, 0.0)
    return t


def _kinds(patterns: tuple[int, ...], kind_of) -> Transducer:
    """One state; patterns become 1000 and their kind, what is not ``patterns`` passes."""
    t = Transducer()
    for s in [*_every(NEGATED | REPORTED | AIMED), TARGET + AIMED, *range(1000, 1000 + len(KINDS))]:
        kind = kind_of(s) if s < 1000 and s % 16 in patterns else None
        t.arcs[0, s] = (0, s, 0.0) if kind is None else (0, 1000 + KINDS.index(kind), PRIOR_WEIGHTS[KINDS.index(kind)])
    return t


def insults() -> Transducer:
    return _kinds((INSULT,), lambda s: "negated" if s & NEGATED else "reported" if s & REPORTED else "targeted" if s & AIMED else "plain")


def threats() -> Transducer:
    """Threats, and targets that come late."""
    return _kinds((THREAT, TARGET), lambda s: None if s == TARGET else "late" if s % 16 == TARGET else "negated" if s & NEGATED else "reported" if s & REPORTED else "threat" if s & AIMED else "loose")


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """The composition as tables by state and symbol: next state, and kind or -1."""
    whole = negation().compose(reported()).compose(targeted()).compose(insults()).compose(threats())
    n = 1 + max(p for p, _ in whole.arcs)
    after, kind = [[0] * 9 for _ in range(n)], [[-1] * 9 for _ in range(n)]
    for (p, s), (q, written, _) in whole.arcs.items():
        after[p][s], kind[p][s] = q, written - 1000 if written >= 1000 else -1
    return after, kind


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”„«»]|[.!?;:,]|\n")
_SIGNS = {**dict.fromkeys("\"“”„«»", QUOTE), **dict.fromkeys(".!?;:,", CLAUSE), "\n": LINE}
_FIXED = {**dict.fromkeys(REPORTS, (REPORT, 0.0)), **dict.fromkeys(NEGATIONS, (NEGATION, 0.0)), **dict.fromkeys(TARGETS, (TARGET, 0.0))}
N_FEATURES = len(KINDS) + 3


@dataclass
class Model:
    """``words`` and ``prefixes`` with their weights; ``weights`` of the features and, last, the intercept."""

    words: dict[str, float]
    prefixes: dict[str, float]
    weights: np.ndarray

    def __post_init__(self):
        self.after, self.kind = grammar()
        self.known: dict[str, tuple[int, float] | None] = {}

    def _look_up(self, word: str) -> tuple[int, float] | None:
        """Symbol and weight of a word; None for others."""
        weight = max(self.words.get(word, 0.0), *[self.prefixes.get(word[:n], 0.0) for n in range(LEAST_PREFIX, MOST_PREFIX + 1) if n <= len(word)], 0.0)
        if word in _THREAT_SET:
            return THREAT, max(weight, SEED_WEIGHT)
        return (INSULT, weight) if weight > 0 else _FIXED.get(word)

    def symbols(self, words: list[str]) -> dict[str, tuple[int, float] | None]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self._look_up(w)
        return self.known

    def clauses(self, text: str):
        """(start, end, kinds with their weights) of each clause with a match, in code points."""
        low, known = text.lower(), self.known
        if len(low) != len(text):  # a few letters have longer small ones
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
            self.symbols(_WORD.findall(low))
        state, start, found, end = 0, None, [], 0
        for m in _TOKEN.finditer(low):
            token = m.group()
            sign = _SIGNS.get(token)
            symbol, weight = (sign, 0.0) if sign is not None else known.get(token) or (OTHER, 0.0)
            kind, state = self.kind[state][symbol], self.after[state][symbol]
            if sign in (CLAUSE, LINE):
                if found:
                    yield start, end, found
                start, found = None, []
                continue
            start, end = m.start() if start is None else start, m.end()
            if kind >= 0:
                found.append((kind, weight or 1.0))
        if found:
            yield start, end, found

    def features(self, texts: list[str | None]) -> np.ndarray:
        """By kind the summed weights, then the heaviest clause, the number of clauses that match and how dense matches are; all as log(1 + x)."""
        out = np.zeros((len(texts), N_FEATURES))
        for i, text in enumerate(texts):
            words = _WORD.findall((text or "").lower())
            known = self.symbols(words)
            if not any([(x := known[w]) and x[0] in _PATTERNS for w in words]):
                continue
            matches = 0
            for _, _, found in self.clauses(text):
                for kind, weight in found:
                    out[i, kind] += weight
                out[i, -3] = max(out[i, -3], sum(PRIOR_WEIGHTS[k] * w for k, w in found))
                out[i, -2] += 1
                matches += len(found)
            out[i, -1] = 100 * matches / len(words)
        return np.log1p(out)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -50, 50)))


_THREAT_SET = frozenset(THREATS)
#: Weights that hold where no labels speak: those of the kinds, none of the shape, and an intercept that asks for a clear clause.
PRIOR = np.array([*PRIOR_WEIGHTS, 0.5, 0.5, 0.5, -4.0])


def fit_weights(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, with a ridge around PRIOR; weighted rows."""
    full, w = np.column_stack((x, np.ones(len(x)))), PRIOR.copy()
    pull = np.full(full.shape[1], RIDGE)
    pull[-1] = RIDGE / 100

    def loss(v):
        z = full @ v
        return float(weight @ (np.logaddexp(0, z) - toxic * z) + 0.5 * pull @ (v - PRIOR) ** 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -50, 50)))
        slope = full.T @ (weight * (p - toxic)) + pull * (w - PRIOR)
        step = np.linalg.solve((full * (weight * p * (1 - p))[:, None]).T @ full + np.diag(pull), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of different labelled texts that are not held out, and how many different ones there are of each label.

    Of each label those of the least hashes, all if there are no more. A text with several labels
    has the more frequent one. Texts are read twice and not shuffled; only hashes meet the labels.
    """
    told = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("of_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("of_id"))).groupBy("of_id").agg(F.max("toxic").alias("toxic"))
    hashed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit("toxicity"), "text").alias("h"))
    met = hashed.join(told.hint("merge"), F.col("doc_id") == F.col("of_id"))
    texts = materialize(met.groupBy("h").agg((2 * F.sum("toxic") >= F.count(F.lit(1))).cast("int").alias("toxic"), F.min("doc_id").alias("of_id")), "toxic-labels")
    counts = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = [texts.where(F.col("toxic") == y).orderBy("h").limit(n) for y, n in ((1, toxic_docs), (0, clean_docs))]
    chosen = materialize(least[0].unionByName(least[1]), "toxic-chosen")  # at most toxic_docs + clean_docs rows
    side = F.broadcast(chosen.select("of_id", F.col("h").alias("of_h"), "toxic"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, (F.col("doc_id") == F.col("of_id")) & (F.xxhash64(F.lit("toxicity"), "text") == F.col("of_h")))
    # by hash again: an id may have a text twice
    return found.select("of_h", "toxic", "text").dropDuplicates(["of_h"]), counts


def _terms(text: str) -> set[str]:
    """Whole words, with a mark at the end, and their beginnings."""
    words = set(_WORD.findall(text.lower()))
    return {w + "$" for w in words if len(w) <= 40} | {w[:n] for w in words for n in range(LEAST_PREFIX, MOST_PREFIX + 1) if n <= len(w)}


def _count_terms(among: frozenset | None):
    """Texts to terms with the number of texts that have them, one count for each batch."""

    def run(batches):
        for batch in small_batches(batches):
            counts: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for t in _terms(text) if among is None else _terms(text) & among:
                    counts[t] = counts.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """Fit words and weights on labelled texts that are not held out, by text and ``labels.toxic`` alone.

    The sample is bounded (``training_sample``), and so are the at most ``MOST_TERMS`` terms and the
    features of one in ``CALIBRATION`` of the sample, which the driver holds. Without toxic or without
    other texts there is nothing to compare: the fixed words and PRIOR alone make the model.
    """
    sample, counts = training_sample(docs, labels, toxic_docs, clean_docs)
    if not counts.get(0) or not counts.get(1):
        return Model({}, {}, PRIOR.copy())
    sample = materialize(sample.withColumn("apart", F.pmod(F.xxhash64(F.lit("calibration"), "of_h"), F.lit(CALIBRATION)) == 0).drop("of_h").repartition(16), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.where("not apart").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_DOCS, int(np.ceil(LEAST_SHARE * n1)))
    tally = lambda toxic, among, rows: sample.where(f"not apart and toxic = {toxic}").select("text").mapInArrow(_count_terms(among), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= rows).toArrow()
    often = tally(1, None, least)
    a = dict(zip(often.column("term").to_pylist(), often.column("n").to_pylist(), strict=True))
    rest = tally(0, frozenset(a), 1)
    b = dict(zip(rest.column("term").to_pylist(), rest.column("n").to_pylist(), strict=True))
    bound = {}
    for term, n in a.items():
        other = b.get(term, 0)
        odds = np.log((n + 0.5) / (n1 - n + 0.5)) - np.log((other + 0.5) / (n0 - other + 0.5))
        bound[term] = float(odds - 1.96 * np.sqrt(1 / (n + 0.5) + 1 / (other + 0.5)))
    kept = sorted((t for t, w in bound.items() if w >= LEAST_WEIGHT), key=lambda t: (-bound[t], t))[:MOST_TERMS]
    model = Model({t[:-1]: bound[t] for t in kept if t.endswith("$")}, {t: bound[t] for t in kept if not t.endswith("$")}, PRIOR.copy())
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.prefixes, model.weights))

    def run(batches):
        local = Model(*shared.value)
        for batch in small_batches(batches):
            x = local.features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.where("apart").select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").toArrow()
    toxic = rows.column("toxic").to_numpy().astype(float)
    if 0 < toxic.sum() < len(toxic):
        x = np.array(rows.column("x").to_pylist())
        share = counts[1] / (counts[0] + counts[1])  # of toxic texts among all, which the sample has more of
        order = np.lexsort((*x.T, toxic))  # the same sums whatever the order of rows
        weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
        model.weights = fit_weights(x[order], toxic[order], weight[order])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``THRESHOLD`` on) of every whole text, and n_clauses, how many match.

    Null and empty texts have no clauses and the score of the intercept. A null doc_id is carried along and never held out, repeated
    rows stay, other columns are ignored; an empty table gives an empty result. Neither labels nor lang, source or doc_id are inputs of a score.
    """
    model = model or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.prefixes, model.weights))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_clauses", pa.int64())])

    def run(batches):
        local = Model(*shared.value)
        for batch in small_batches(batches):
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                x = local.features(texts[a:b])
                score = local.scores(x)
                columns = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, -2])).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_clauses long")


def matched_clauses(docs: DataFrame, model: Model) -> DataFrame:
    """The clauses that match: doc_id, start and end (code points), clause, kinds and score (the weight of its path)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.prefixes, model.weights))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("clause", pa.string()), ("kinds", pa.list_(pa.string())), ("score", pa.float64())])

    def run(batches):
        local = Model(*shared.value)
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                local.symbols(_WORD.findall((text or "").lower()))
                rows = [(doc_id, s, e, text[s:e], [KINDS[k] for k, _ in found], float(sum(PRIOR_WEIGHTS[k] * w for k, w in found))) for s, e, found in local.clauses(text or "")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, clause string, kinds array<string>, score double")
