"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation over the
counts of vote patterns fits one good kind of documents and as many bad kinds as the data support, each
with its chances of every labeller's three votes; labellers that err together do so within a kind. The
posterior of a document's pattern is the soft label on which a hashed linear scorer is trained.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.operators.ranking import placed

from .shingles import chunks, mix

#: The scorer is fitted, in one task, on the features of at most this many different texts: those of the least hashes.
TRAIN_DOCS = 10_000
#: Rows that a task may hold to find the least of them.
AT_ONCE = 100_000
FEATURES = 1 << 14
ITERATIONS = 150
RIDGE = 1e-4
KEEP_SCORE = 0.5
EM_ROUNDS = 200
#: Random starts, of which the likeliest counts, and the most kinds of documents that are tried.
EM_STARTS = 12
MOST_KINDS = 8
#: Pseudo-count of each vote in each kind.
PRIOR = 0.5
GOOD, BAD, ABSTAIN = 1, -1, 0
LEAST_TOKENS = 20
#: Labeller: signal, what it is a share of, bad above, good below (None: votes bad only).
RATES = {
    "repeats": ("repeats", "tokens", 0.2, 0.08),
    "symbols": ("symbols", "chars", 0.05, 0.01),
    "marks": ("marks", "tokens", 0.2, None),
    "capitals": ("capitals", "chars", 0.15, 0.08),
    "shouts": ("shouts", "tokens", 0.2, None),
}
LABELLERS = ("variety", *RATES, "stops")

_SPACE, _UPPER, _LOWER, _DIGIT, _PLAIN, _STOP, _SHOUT, _SYMBOL = range(8)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point."""
    kind, low = np.full(0x110000, _SYMBOL, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        category = unicodedata.category(c)
        if c.isspace():
            kind[cp] = _SPACE
        elif category == "Lu":
            kind[cp] = _UPPER
        elif category[0] in "LM":
            kind[cp] = _LOWER
        elif category[0] == "N":
            kind[cp] = _DIGIT
        elif c in ".?":
            kind[cp] = _STOP
        elif c in ",;:'’-":
            kind[cp] = _PLAIN
        elif c == "!":
            kind[cp] = _SHOUT
        small = c.lower()
        if len(small) == 1:
            low[cp] = ord(small)
    return kind, low


def _run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``values``."""
    n = len(values)
    steps = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, dtype=np.uint64))), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * steps(_BASE)[:n], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * steps(_INVERSE)[start])


def signals(texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Signals of each text, and the hashed features of each (with repeats, before counting)."""
    kind_of, low_of = _tables()
    parts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    cp = np.frombuffer(" ".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    kind = kind_of[cp]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[at[1:]] - total[at[:-1]]

    def runs(mask: np.ndarray) -> np.ndarray:
        return mask & ~np.concatenate(([False], mask[:-1]))

    symbol = kind >= _SHOUT
    word = kind != _SPACE
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    first, last = edge[::2], edge[1::2]
    tokens = _run_hashes(low_of[cp], first, last)
    # shapes: runs of capitals, small letters and digits as one sign each, other characters as they are
    sign = np.where(kind == _UPPER, np.uint32(1), np.where(kind == _LOWER, np.uint32(2), np.where(kind == _DIGIT, np.uint32(3), cp + np.uint32(16))))
    new = np.concatenate(([True], sign[1:] != sign[:-1])) & word
    new[first] = True
    place = np.concatenate(([0], np.cumsum(new)))
    shapes = _run_hashes(sign[new], place[first], place[last])
    begin, end = np.searchsorted(first, at[:-1]), np.searchsorted(first, at[1:])
    again = np.concatenate(([False], tokens[1:] == tokens[:-1]))
    again[begin[begin < len(again)]] = False
    total = np.concatenate(([0], np.cumsum(again)))
    n_tokens, repeats = end - begin, total[end] - total[begin]
    places = (tokens % np.uint64(FEATURES)).astype(np.int64), (mix(shapes) % np.uint64(FEATURES)).astype(np.int64)
    distinct = np.fromiter((len(np.unique(tokens[a:b])) for a, b in zip(begin, end, strict=True)), dtype=np.int64, count=len(parts))
    out = {
        "chars": sizes, "tokens": n_tokens, "repeats": repeats, "symbols": count(symbol), "marks": count(runs(symbol)), "capitals": count(kind == _UPPER), "shouts": count(runs(kind == _SHOUT)),
        "stops": count(kind == _STOP), "variety": np.log(distinct + 1.0) / np.log(np.maximum(n_tokens, 1) + 1.0),
    }
    features = [np.concatenate((places[0][a:b], places[1][a:b], np.zeros(r, dtype=np.int64))) for a, b, r in zip(begin, end, repeats, strict=True)]
    return out, features


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, labellers) votes in order of LABELLERS; texts under LEAST_TOKENS words get none."""
    enough = s["tokens"] >= LEAST_TOKENS
    vote = lambda bad, good: np.where(enough & bad, BAD, np.where(enough & good, GOOD, ABSTAIN))
    columns = [vote(s["variety"] < 0.72, s["variety"] > 0.80)]
    for signal, whole, bad, good in RATES.values():
        rate = s[signal] / np.maximum(s[whole], 1)
        columns.append(vote(rate > bad, rate < good if good is not None else np.zeros(len(rate), dtype=bool)))
    rate = s["stops"] / np.maximum(s["tokens"], 1)
    columns.append(vote((rate < 0.01) & (s["tokens"] >= 2 * LEAST_TOKENS), (rate >= 0.03) & (rate <= 0.3)))
    return np.stack(columns, axis=1).astype(np.int32)


def _fit_kinds(one: np.ndarray, n: np.ndarray, kinds: int, seed: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, responsibilities (kinds, patterns), shares and vote chances (kinds, labellers, votes) of one start."""
    post = np.random.default_rng(seed).dirichlet(np.full(kinds, 0.3), size=len(one)).T
    for _ in range(EM_ROUNDS):
        weight = post * n
        chance = np.einsum("kp,plv->klv", weight, one) + PRIOR
        chance /= chance.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (n.sum() + kinds)
        logs = np.log(share)[:, None] + np.einsum("plv,klv->kp", one, np.log(chance))
        top = logs.max(axis=0)
        total = top + np.log(np.exp(logs - top).sum(axis=0))
        new = np.exp(logs - total)
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
    return float(total @ n), post, share, chance


def fit_votes(patterns: list[list[int]], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and chances by labeller, class (bad, good) and vote (bad, abstain, good).

    A mixture of kinds within which labellers vote independently, abstentions included. Kinds are
    added while the Bayesian information criterion falls; of several random starts the likeliest counts.
    Good is the kind with the most good votes less bad ones, bad are all others. Documents
    on which nobody votes tell nothing and get the share of good ones; so do all if there are no votes.
    """
    x, n = np.array(patterns, dtype=int).reshape(len(patterns), len(patterns[0]) if len(patterns) else 0), np.array(counts, dtype=float)
    asked = (x != ABSTAIN).any(axis=1)
    if not asked.any():
        return np.ones(len(x)), np.full((x.shape[1], 2, 3), 1 / 3)
    order = np.flatnonzero(asked)[np.lexsort(x[asked].T)]  # the same fit whatever the order of patterns
    one, m = np.stack([x[order] == v for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(float), n[order]
    best, least = None, np.inf
    for kinds in range(1, MOST_KINDS + 1):
        fit = max((_fit_kinds(one, m, kinds, seed) for seed in range(EM_STARTS)), key=lambda f: f[0])
        price = -2 * fit[0] + (kinds * 2 * x.shape[1] + kinds - 1) * np.log(m.sum())
        if price >= least:
            break
        best, least = fit, price
    _, found, share, chance = best
    good = int((chance[:, :, 2] - chance[:, :, 0]).sum(axis=1).argmax())
    post = np.full(len(x), share[good])
    post[order] = found[good]
    bad = np.delete(share, good)
    mixed = np.tensordot(bad / bad.sum(), np.delete(chance, good, axis=0), 1) if len(bad) else np.full_like(chance[0], 1 / 3)
    return post, np.stack([mixed, chance[good]], axis=1)


def _unit_counts(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features with their counts, scaled to length one."""
    place, n = np.unique(features, return_counts=True)
    return place, n / max(float(np.sqrt((n.astype(float) ** 2).sum())), 1.0)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression on soft labels.

    Accelerated gradient descent; features have length one, so a step of 4 keeps within the curvature of 1/4 and the ridge.
    """
    size = np.array([len(p) for p, _ in rows], dtype=np.int64)
    full = np.flatnonzero(size)
    place, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    row, starts = np.repeat(np.arange(len(rows)), size), (np.cumsum(size) - size)[full]
    w = look = np.zeros(features + 1)
    for step in range(ITERATIONS):
        z = np.full(len(rows), look[-1])
        if len(full):
            z[full] += np.add.reduceat(look[place] * value, starts)
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        slope = np.append(np.bincount(place, off[row] * value, features), off.sum()) + RIDGE * look
        moved = look - 4.0 * slope
        look, w = moved + step / (step + 3) * (moved - w), moved
    return w


_SCORED = "doc_id long, votes array<int>, posterior double, score double, keep boolean"


def _count_votes(batches):
    """Texts to the vote patterns of each batch with their counts."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in chunks(texts):
            patterns, n = np.unique(votes(signals(texts[a:b])[0]), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(patterns), pa.list_(pa.int32())), pa.array(n, pa.int64())], names=["votes", "n"])


def _featured(batches):
    """(h, text) to h, votes and the unit feature vector."""
    schema = pa.schema([("h", pa.int64()), ("votes", pa.list_(pa.int32())), ("place", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in chunks(texts):
            s, features = signals(texts[a:b])
            units = [_unit_counts(f) for f in features]
            columns = [batch.column(0).slice(a, b - a), pa.array(list(votes(s)), pa.list_(pa.int32())), pa.array([u[0] for u in units], pa.list_(pa.int32())), pa.array([u[1] for u in units], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def vote_counts(docs: DataFrame) -> DataFrame:
    """votes and n: how many documents have each pattern, at most 3 to the number of labellers."""
    return docs.select("text").mapInArrow(_count_votes, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def training_sample(docs: DataFrame, n_docs: int, most: int = TRAIN_DOCS) -> DataFrame:
    """h, votes, place and value of ``most`` different texts, or of all if there are no more: those of the least hashes, each once.

    ``n_docs`` is the number of different texts, not of rows: copies neither crowd others out nor leave the sample
    empty. At any number about twice ``most`` are looked at.
    """
    hashed = docs.where("text is not null").select(F.xxhash64(F.lit("sample"), F.col("text")).bitwiseAND(F.lit((1 << 63) - 1)).alias("h"), "text")
    cut = min((1 << 63) - 1, (1 << 63) * 2 * most // max(n_docs, 1))
    texts = hashed.where(F.col("h") <= cut).distinct()
    features = "h long, votes array<int>, place array<int>, value array<double>"
    if most <= AT_ONCE:
        return texts.mapInArrow(_featured, features).orderBy("h").limit(most)
    # a queue of so many rows would not fit into a task: the least hashes by their places
    least = placed(texts.select("h"), [], [F.col("h")]).where(F.col("place") <= most).select("h")
    return texts.join(least.hint("merge"), "h").select("h", "text").mapInArrow(_featured, features)


def score_documents(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Quality of every document: doc_id, votes, posterior, score, keep.

    ``votes`` has one vote per labeller in order of LABELLERS, ``posterior`` is the label model's
    chance that a document with these votes is good, ``score`` the linear scorer's (0 to 1),
    ``keep`` whether it is at least ``KEEP_SCORE``. Texts count whole. Null and empty texts have no
    words: all labellers abstain, the score is 0 and they are never kept. A null doc_id is carried
    along; repeated rows stay and score alike; other columns are ignored; an empty table gives an
    empty result. The driver sees the counts of vote patterns, at most 3 to the number of
    labellers, and the scorer's weights; the scorer is fitted on at most ``train_docs`` different texts.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = vote_counts(source).collect()
    posterior: dict[tuple, float] = {}
    if counted:
        post, _ = fit_votes([r["votes"] for r in counted], [r["n"] for r in counted])
        posterior = {tuple(r["votes"]): float(p) for r, p in zip(counted, post, strict=True)}

    def fit(batches):
        rows, target = [], []
        for batch in batches:
            for vote, place, value in zip(*[batch.column(c).to_pylist() for c in ("votes", "place", "value")], strict=True):
                rows.append((np.array(place, dtype=np.int64), np.array(value)))
                target.append(posterior[tuple(vote)])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(fit_scorer(rows, np.array(target)))], names=["w"])

    different = source.where("text is not null").select(F.xxhash64("text")).distinct().count()
    weights = training_sample(source, different, train_docs).coalesce(1).mapInArrow(fit, "w double").toArrow().column("w").to_numpy() if counted else np.zeros(0)
    weights = weights if len(weights) else np.zeros(FEATURES + 1)  # only where there are no texts at all
    shared = docs.sparkSession.sparkContext.broadcast((posterior, weights))

    def score(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.list_(pa.int32())), ("posterior", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])
        known, w = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                s, features = signals(texts[a:b])
                voted = votes(s)
                z = np.array([w[-1] + float(w[p] @ v) for p, v in map(_unit_counts, features)])
                points = np.where(s["tokens"] > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
                columns = [batch.column(0).slice(a, b - a), pa.array(list(voted), pa.list_(pa.int32())), pa.array([known[tuple(v)] for v in voted.tolist()], pa.float64()), pa.array(points), pa.array(points >= KEEP_SCORE)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return source.mapInArrow(score, _SCORED)
