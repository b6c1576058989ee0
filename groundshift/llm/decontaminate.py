"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every k-gram of a text is hashed once; winnowing keeps the least hash of each sliding window of k-grams,
so a text has about one fingerprint to three or four words, and two texts that share ``window``
words share one of those. Fingerprints of documents and benchmark items are joined, and around each joined
position the windows that contain it are compared word by word. Hits that touch become one span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_side, materialize

WINDOW = 10
KGRAM = 5
#: Counted rows of hashes, and measured bytes of other sides, up to which they are broadcast.
HASHES_BROADCAST = 400_000
BYTES_BROADCAST = 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = "array<struct<pos: int, h: bigint>>"


def words(text: Column) -> Column:
    """Words of a text: ASCII letters lower-cased, all other code points from U+0080 on kept."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _range(n: Column, what) -> Column:
    """``what`` of 0 to n - 1; null if n is not positive."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), what))


def _extreme(of, parts: list[Column]) -> Column:
    return of(*parts) if len(parts) > 1 else parts[0]


def _grams(w: Column, k: int) -> Column:
    """Hash of the k words from each position on."""
    return _range(F.size(w) - (k - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def _numbered_grams(w: Column, n: int) -> Column:
    """(n, pos, h) of every position that has n words."""
    rows = F.transform(_grams(w, n), lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("pos"), h.alias("h")))
    return F.coalesce(rows, F.array().cast("array<struct<n: int, pos: int, h: bigint>>"))


def fingerprints(w: Column, window: int = WINDOW) -> Column:
    """(pos, h) of the k-grams that winnowing keeps: the least of some window of them, ties all.

    An array in order of position; empty for fewer than ``window`` words.
    """
    k = min(KGRAM, window)
    span = window - k + 1

    def keep(h: Column) -> Column:
        least = _range(F.size(h) - (span - 1), lambda i: _extreme(F.least, [F.get(h, i + j) for j in range(span)]))

        def kept(m: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i) == _extreme(F.greatest, [F.get(m, i - j) for j in range(span)]))
            return F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(h, i).alias("h")))

        return _let(least, kept)

    return F.coalesce(F.when(F.size(w) >= window, _let(_grams(w, k), keep)), F.array().cast(_MARKS))


def _by_length(n: Column, lengths: list[int], what) -> Column:
    return reduce(lambda c, x: c.when(n == x, what(x)), lengths, F.when(F.lit(False), F.lit(None)))


def _window_text(w: Column, start: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(w, start + j) for j in range(n)])


def _bytes(df: DataFrame, *texts: str) -> int:
    size = reduce(lambda a, b: a + b, [F.octet_length(F.col(t)) for t in texts], F.lit(32 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def _joined(doc_rows: DataFrame, hashes: DataFrame, keys: list[str]) -> DataFrame:
    return doc_rows.join(checked_side(hashes, hashes.count(), HASHES_BROADCAST), keys, "left_semi")


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, without_id: bool = False) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    Returns doc_id, n_words, n_hit, n_items, item_ids (sorted strings), spans (array of start word and
    length, in order, none touching the next), contaminated; one row for each row of ``docs``, which needs
    doc_id and text. Items of fewer words than ``window`` are one window of their own length, hashed and
    joined whole; items without words have none. Null or wordless texts have no words and no hits. Repeated
    rows stay, equal ids with different texts are judged apart, a null id is kept. Items without id are
    left out, or with ``without_id`` are hits that add no id. An empty benchmark hits nothing; other columns
    are ignored. Sides of joins are broadcast up to a counted or measured bound, beyond it merged.
    """
    prints, judged = _judge(docs, benchmark, window, without_id)
    size = judged.agg(F.coalesce(F.sum((F.size("inside") + F.size("item_ids")) * 32 + 64), F.lit(0))).first()[0]
    out = prints.join(checked_side(judged, size, BYTES_BROADCAST), _same(), "left")
    out = out.withColumns({"inside": F.coalesce("inside", F.array().cast("array<int>")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    inside = F.col("inside")
    first = F.filter(inside, lambda x, i: F.coalesce(F.get(inside, i - 1) != x - 1, F.lit(True)))
    last = F.filter(inside, lambda x, i: F.coalesce(F.get(inside, i + 1) != x + 1, F.lit(True)))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("inside").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("spans"), (F.size("inside") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all columns; items without id count."""
    judged = _judge(docs, benchmark, window, True)[1].select("of_id", "of_th")
    side = checked_side(judged, judged.count(), HASHES_BROADCAST)
    return docs.join(side, docs["doc_id"].eqNullSafe(side["of_id"]) & (F.xxhash64(docs["text"]) == side["of_th"]), "left_anti")


def _judge(docs: DataFrame, benchmark: DataFrame, window: int, without_id: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, th (a hash of the text), n_words and fingerprints of every row; and, for the texts that have any,
    of_id, of_th, the positions inside benchmark windows and the sorted ids of the items."""
    k = min(KGRAM, window)
    key = F.xxhash64("text")
    items = (benchmark if without_id else benchmark.where(F.col("item_id").isNotNull())).select(F.col("item_id").cast("string").alias("item"), F.explode(F.array(words(F.col("text")))).alias("w"))
    items = materialize(items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window))), "bench-items")
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 values
    lengths = [*short, window]

    # 1. fingerprints of all documents; beside them those of whole short items, which winnowing cannot thin
    prints = materialize(
        docs.select("doc_id", key.alias("th"), _let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), fingerprints(w, window).alias("marks"))).alias("f")), "doc-prints"
    ).select("doc_id", "th", F.coalesce("f.n_words", F.lit(0)).alias("n_words"), "f.marks")
    hashes = items.where(F.col("n") == window).select(F.explode(fingerprints(F.col("w"), window)).alias("m")).select("m.h").distinct()
    found = _joined(prints.select("doc_id", "th", F.explode("marks").alias("m")).select("doc_id", "th", F.lit(window).alias("n"), "m.pos", "m.h"), materialize(hashes, "bench-hashes"), ["h"])
    if short:
        whole = materialize(items.where(F.col("n") < window).select("n", _by_length(F.col("n"), short, lambda n: F.get(_grams(F.col("w"), n), F.lit(0))).alias("h")).distinct(), "bench-short")
        every = lambda w: F.concat(*[_numbered_grams(w, n) for n in short])
        rows = docs.select("doc_id", key.alias("th"), F.explode(_let(words(F.col("text")), every)).alias("m")).select("doc_id", "th", "m.n", "m.pos", "m.h")
        found = found.unionByName(_joined(rows, whole, ["n", "h"]))

    # 2. the windows around each joined position, of the documents that have any
    marks = materialize(found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("n", "pos")).alias("marks")), "doc-marks")
    size = marks.agg(F.coalesce(F.sum(F.size("marks") * 16 + 64), F.lit(0))).first()[0]
    side = checked_side(marks.withColumnsRenamed({"doc_id": "of_id", "th": "of_th"}), size, BYTES_BROADCAST)
    texts = docs.select("doc_id", key.alias("th"), "text").join(side, _same())
    texts = texts.select("doc_id", "th", "marks", F.explode(F.array(words(F.col("text")))).alias("w"))
    around = F.flatten(F.transform("marks", lambda m: F.transform(F.when(m["n"] == window, F.sequence(F.greatest(F.lit(0), m["pos"] - (window - k)), m["pos"])).otherwise(F.array(m["pos"])), lambda s: F.struct(m["n"].alias("n"), s.alias("start")))))
    wins = texts.select("doc_id", "th", F.explode(F.transform(F.array_distinct(around), lambda a: F.struct(a["n"].alias("n"), a["start"].alias("start"), F.when(a["start"] + a["n"] <= F.size("w"), _by_length(a["n"], lengths, lambda n: _window_text(F.col("w"), a["start"], n))).alias("win")))).alias("a"))
    wins = wins.select("doc_id", "th", "a.n", "a.start", "a.win").where("win is not null")

    # 3. equal windows of the benchmark
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n")))
    bench = materialize(items.select("item", "n", "w", at.alias("start")).select("item", "n", _by_length(F.col("n"), lengths, lambda n: _window_text(F.col("w"), F.col("start"), n)).alias("win")).distinct(), "bench-windows")
    distinct = bench.select("n", "win").distinct()
    hits = materialize(wins.join(checked_side(distinct, _bytes(bench, "win"), BYTES_BROADCAST), ["n", "win"], "left_semi"), "doc-hits")
    inside = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))))
    spots = hits.groupBy("doc_id", "th").agg(inside.alias("inside"))
    named = hits.select("doc_id", "th", "n", "win").distinct().join(checked_side(bench, _bytes(bench, "win", "item"), BYTES_BROADCAST), ["n", "win"])
    named = named.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    judged = spots.join(named.withColumnsRenamed({"doc_id": "of_id", "th": "of_th"}).hint("merge"), _same())
    judged = materialize(judged.select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), "inside", "item_ids"), "doc-judged")
    return prints, judged
