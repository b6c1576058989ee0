"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words; a document of the source is taken ``target / source_size``
times in expectation. The fractional part of that is rounded by the pivotal method: two documents
meet, one hands probability mass to the other at random until one of the two is integral, and the
other meets the next document. Groups of bounded size are rounded independently, each leaves at
most one residual, and residuals meet again one level up in a reduction tree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_side, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
GROUP_ROWS = 2048
FAN_IN = 256
SOURCES_BROADCAST = 10_000
_TINY = 1e-9
#: Equal rows are one item; so many of them are written by one task at most.
RUN_ROWS = 10_000
_STATE = "doc_id long, size long, n_rows long, rank int, grp long, base long, extra long, frac double"


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per source: rank, n_items, source_size, target.

    ``sized`` has ``source``, ``size`` and ``n_rows``, the number of documents that a row, an item, stands for. Sources are ranked by code point, null last, and weigh
    ``weights`` in turn. Targets share ``share`` times all words by weight; a target stops at
    ``cap`` times its source's size and the excess is shared again among the others. That fixed
    point is the water level ``max_i (total - caps before i) / (weights from i on)`` over sources
    sorted by cap per weight, so one pass of window sums over the table of sources finds it.
    """
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_items"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .select("source", "rank", "n_items", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def _uniform(seed: str, *keys) -> float:
    """A number in [0, 1) that depends on the seed and the keys alone, so that reruns agree."""
    digest = hashlib.blake2b(":".join(map(str, (seed, *keys))).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def pivotal_round(items: list[tuple], seed: str) -> tuple[list[int], list[float]]:
    """Round (key, frac) pairs in the given order; returns added copies and left fractions.

    At most one left fraction is not 0; the sum of copies and fraction equals the sum of ``frac``.
    """
    add, left = [0] * len(items), [0.0] * len(items)
    held, p = -1, 0.0
    for i, (key, q) in enumerate(items):
        if q <= _TINY:
            continue
        if q >= 1 - _TINY:
            add[i] = 1
            continue
        if held < 0:
            held, p = i, q
            continue
        u, s = _uniform(seed, items[held][0], key), p + q
        if s <= 1 - _TINY:  # one gets all mass, the other none
            if u * s < p:
                p = s
            else:
                held, p = i, s
        elif s < 1 + _TINY:  # both become integral
            add[held if u < p else i] = 1
            held, p = -1, 0.0
        elif u * (2 - s) < 1 - q:  # one becomes 1, the other keeps the rest
            add[held] = 1
            held, p = i, s - 1
        else:
            add[i] = 1
            p = s - 1
    if held >= 0:
        left[held] = p
    return add, left


def _round_groups(state: DataFrame, seed: str) -> DataFrame:
    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        rows.sort(key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"] or 0))
        add, left = pivotal_round([((i, r["doc_id"]), r["frac"]) for i, r in enumerate(rows)], seed)
        for r, a, f in zip(rows, add, left, strict=True):
            r["extra"] += a
            r["frac"] = f
        return pa.Table.from_pylist(rows, schema=part.schema)

    return state.groupBy("rank", "grp").applyInArrow(run, _STATE)


def mix_sources(docs: DataFrame, seed: str = "mix", share: float = 1.5, cap: float = 2.0, weights=WEIGHTS,
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, source, copies.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns are ignored. Null or blank
    texts have size 0 and are taken 0 words. A null source is a source of its own, the last one.
    Rows equal in doc_id, source and size are one item with the sum of their fractions, so that they
    meet in no group; as many of them as it gets copies are taken once more, each at most once.
    A null doc_id is carried along. No document is taken
    more than ``ceil(cap)`` times. An empty table gives an empty result. Within a group documents
    are rounded in order of size, so that mass moves between documents of like size and the words
    taken stay close to the target. Broadcast: the table of sources, if it has at most
    ``SOURCES_BROADCAST`` counted rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))
    sized = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "mix-sizes")
    targets = materialize(source_targets(sized, share, cap, weights), "mix-targets")
    n_sources, most = targets.agg(F.count(F.lit(1)), F.coalesce(F.max("n_items"), F.lit(0))).first()
    side = targets.select(F.col("source").alias("src"), "rank", "n_items", "source_size", "target")
    per_doc = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    groups = F.ceil(F.col("n_items") / F.lit(group_rows))
    state = (
        sized.join(checked_side(side, n_sources, SOURCES_BROADCAST), F.col("source").eqNullSafe(F.col("src")))
        .withColumn("rate", F.when(F.col("size") > 0, per_doc).otherwise(0.0))
        .withColumn("base", F.floor(F.col("rate") + F.lit(_TINY)).cast("long"))
        .withColumn("sum", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")) * F.col("n_rows"))
        .withColumn("extra", F.floor(F.col("sum") + F.lit(_TINY)).cast("long"))
        .select("doc_id", "size", "n_rows", "rank", F.pmod(F.xxhash64("doc_id", "size"), groups).alias("grp"), "base", "extra", F.greatest(F.lit(0.0), F.col("sum") - F.col("extra")).alias("frac"))
    )
    n_groups = -(-most // group_rows)
    done, state = [], materialize(_round_groups(state, seed), "mix-level")
    while n_groups > 1:  # one residual per group at most; FAN_IN groups meet in each further level
        done.append(state.where("frac = 0"))
        n_groups = -(-n_groups // FAN_IN)
        state = materialize(_round_groups(state.where("frac > 0").withColumn("grp", F.expr(f"grp div {FAN_IN}")), seed), "mix-level")
    coin = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "rank", "doc_id"), 11) / F.lit(2.0**53)
    state = state.withColumn("extra", F.col("extra") + F.when(coin < F.col("frac"), 1).otherwise(0))
    for part in done:
        state = state.unionByName(part)
    # items back to rows; an item of very many rows in runs that are dealt out
    state = materialize(state, "mix-items")
    few = state.where(F.col("n_rows") <= RUN_ROWS).withColumn("run", F.lit(0).cast("long"))
    many = state.where(F.col("n_rows") > RUN_ROWS).withColumn("run", F.explode(F.expr(f"sequence(0, (n_rows - 1) div {RUN_ROWS})"))).repartition("doc_id", "run")
    rows = few.unionByName(many).withColumn("nth", F.explode(F.expr(f"sequence(run * {RUN_ROWS}, least(n_rows, (run + 1) * {RUN_ROWS}) - 1)")))
    copies = F.col("base") + F.when(F.col("nth") < F.col("extra"), 1).otherwise(0)
    back = targets.select("rank", "source", "source_size", "target")
    return rows.join(checked_side(back, n_sources, SOURCES_BROADCAST), "rank").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies")
    )
