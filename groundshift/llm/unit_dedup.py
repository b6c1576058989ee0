"""Substring dedup by hashing lines, paragraphs or sentences.

Units are runs of whole pieces (sentences, lines or paragraphs) that hold at least ``MIN_WORDS`` words:
a long piece alone, a short one together with as many pieces after it as that takes, and as many
before it. So every repeated run of whole pieces with that many words goes, its short pieces included,
and a short line that merely recurs among other text stays. Digests of normalised units are grouped
over the whole corpus; the occurrence of the lowest rank stays, all others go. Spans are kept as
code-point offsets into the original text.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Least words of a unit. At sf0.1, 3,980 of 9,296 different texts lose something if single lines and sentences of
#: five words count, mostly license and boilerplate lines of 5 to 9 words, and 689 with 15.
MIN_WORDS = 15
#: A word counts once for every so many characters, so that scripts without spaces have units too.
WORD_CHARS = 12
#: Separators of pieces; a piece reaches to the start of the next.
SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n\s*\n"), "sentence": re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n")}
SENTENCE = "sentence"
#: Rank of rows without doc_id.
_LAST = (1 << 63) - 1


def split_pieces(text: str, unit: str = SENTENCE) -> list[tuple[int, int]]:
    """(start, end) of the pieces, which cover the text."""
    out, start = [], 0
    for m in SEPARATORS[unit].finditer(text):
        if m.end() > start:
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def split_units(text: str, unit: str = SENTENCE, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, normalised text) of every unit, sorted: runs of pieces of at least ``min_words`` words."""
    bodies, sizes, spans = [], [], []
    for start, end in split_pieces(text, unit):
        words = text[start:end].lower().split()
        bodies.append(" ".join(words))
        size = len(words)
        if len(bodies[-1]) >= WORD_CHARS * 2:
            size = sum(max(1, len(w) // WORD_CHARS) for w in words)
        sizes.append(size)
        spans.append((start, end))
    # two pointers: the least run that starts, and the least one that ends, at each piece with words
    runs, last, held = set(), 0, 0
    for first in range(len(sizes)):
        while last < len(sizes) and held < min_words:
            held += sizes[last]
            last += 1
        if held < min_words:
            break
        if sizes[first]:
            runs.add((first, last))
        held -= sizes[first]
    first = held = 0
    for last in range(len(sizes)):
        held += sizes[last]
        while held - sizes[first] >= min_words:
            held -= sizes[first]
            first += 1
        if held >= min_words and sizes[last]:
            runs.add((first, last + 1))
    return [(spans[a][0], spans[b - 1][1], bodies[a] if b == a + 1 else " ".join(x for x in bodies[a:b] if x)) for a, b in sorted(runs)]


_UNITS = "doc_id long, th long, d1 long, d2 long, start int, end int"


def _unit_rows(unit: str, min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in small_batches(batches):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: dict[int, int] = {}  # digest to the end of its first occurrence
                for start, end, body in split_units(text, unit, min_words):
                    d = xxhash.xxh3_128_intdigest(body.encode("utf-8", "surrogatepass"))
                    if d in seen:
                        if start < seen[d]:
                            continue  # it overlaps the occurrence that stays
                        d1 = d2 = None  # a repeat within the text goes in any case: it needs no digest
                    else:
                        seen[d] = end
                        d1, d2 = (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)
                    for column, value in zip(rows, (doc_id, th, d1, d2, start, end), strict=True):
                        column.append(value)
                if len(rows[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows = ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def _row_key() -> tuple[Column, Column]:
    """What tells documents apart: the doc_id as a rank (none ranks last) and a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text")


def repeated_spans(docs: DataFrame, unit: str = SENTENCE, min_words: int = MIN_WORDS) -> DataFrame:
    """rank, th and removed: the sorted spans (start, end) of units that repeat an earlier one.

    Only documents with such spans are returned, one row for each doc_id and text (``_row_key``). A
    document ranks by its doc_id, those of one doc_id by the hash of their texts.
    """
    rank, th = _row_key()
    source = docs.where("text is not null").select(rank.alias("doc_id"), th.alias("th"), "text")
    units = materialize(source.mapInArrow(_unit_rows(unit, min_words), _UNITS), "units")
    place = F.struct("doc_id", "th")
    first = units.where("d1 is not null").groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = materialize(first.where("first < last").select("d1", "d2", "first"), "unit-firsts")
    across = units.where("d1 is not null").join(first.hint("merge"), ["d1", "d2"]).where(place > F.col("first")).select("doc_id", "th", "start", "end")
    gone = across.union(units.where("d1 is null").select("doc_id", "th", "start", "end"))
    return gone.groupBy(F.col("doc_id").alias("rank"), "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))


def _kept_pieces(text: str | None, removed) -> tuple[list[dict], list[dict]]:
    """The removed spans merged, and what they leave of the text."""
    at, merged, kept = 0, [], []
    for span in removed or ():
        if merged and span["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], span["end"])
        else:
            merged.append(dict(span))
    for span in merged:
        if span["start"] > at:
            kept.append({"start": at, "end": span["start"]})
        at = span["end"]
    if text and at < len(text):
        kept.append({"start": at, "end": len(text)})
    return merged, kept


def _cut(batches):
    """(doc_id, text, removed) to the rows of _CUT."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in small_batches(batches):
        texts = batch.column(1).to_pylist()
        pieces = [_kept_pieces(t, r) for t, r in zip(texts, batch.column(2).to_pylist(), strict=True)]
        columns = [
            batch.column(0), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array([m for m, _ in pieces], span), pa.array([k for _, k in pieces], span),
            pa.array([None if t is None else "".join(t[x["start"] : x["end"]] for x in k) for t, (_, k) in zip(texts, pieces, strict=True)], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "removed", "kept", "text"])


_CUT = "doc_id long, n_chars long, removed array<struct<start: int, end: int>>, kept array<struct<start: int, end: int>>, text string"


def _with_spans(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """``docs`` with the spans to remove as the last column, _unit_spans."""
    spans = materialize(repeated_spans(docs, unit, min_words), "unit-spans").select(F.col("rank").alias("_unit_rank"), F.col("th").alias("_unit_th"), F.col("removed").alias("_unit_spans"))
    rank, th = _row_key()
    return docs.join(spans.hint("merge"), (rank == F.col("_unit_rank")) & (th == F.col("_unit_th")), "left").select(*docs.columns, "_unit_spans")


def dedup_units(docs: DataFrame, unit: str = SENTENCE, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document without its repeated units: doc_id, n_chars, removed, kept, text.

    ``removed`` and ``kept`` are spans (start, end) in code points of the original text, ``text``
    is what the kept spans hold, ``n_chars`` the original length. A unit stays in the document of
    the lowest doc_id that has it, at its first place there; text in no unit stays. Different texts
    of one doc_id are documents of their own, in order of a hash of the text; rows equal in both are
    one document, cut alike. Rows without doc_id rank last. A null text stays null without spans,
    an empty one stays empty. Other columns are ignored; an empty table gives an empty result.
    """
    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), unit, min_words)
    return rows.select("doc_id", "text", "_unit_spans").mapInArrow(_cut, _CUT)


def cut_documents(docs: DataFrame, unit: str = SENTENCE, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns, the repeated units cut from ``text``, and ``n_chars`` to match.

    Documents are told apart and ranked as in ``dedup_units``. One that loses all but white space
    goes; null and empty texts stay as they are.
    """
    rows, names = _with_spans(docs, unit, min_words), docs.columns

    def run(batches):
        for batch in small_batches(batches):
            columns = dict(zip(names, batch.columns, strict=False))
            texts, cut = columns["text"].to_pylist(), []
            for text, removed in zip(texts, batch.column(len(names)).to_pylist(), strict=True):
                cut.append(text if not removed or text is None else "".join(text[k["start"] : k["end"]] for k in _kept_pieces(text, removed)[1]))
            columns["text"] = pa.array(cut, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if c is t else len(c) for n, c, t in zip(columns["n_chars"].to_pylist(), cut, texts, strict=True)], columns["n_chars"].type)
            stay = pa.array([c is t or bool(c.strip()) for c, t in zip(cut, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(stay)

    return rows.mapInArrow(run, docs.schema)
