"""Cross-tokenizer alignment by products of token-byte incidence matrices.

Two tokenizers cut the same bytes; A and B have a row for each token and a column for each byte. They are kept in
compressed sparse rows, built by hand; Gustavson's row products give A Bᵀ, whose entries are the overlap links with the
number of bytes they share. Byte offsets where tokens of both end cut the tokens into groups; the products of the
token-group incidences link all tokens of a group.

Neither tokenizer merges across a space between two characters that are no white space, so a text is the
concatenation of units cut there, and so are its tokens, links and groups. A worker aligns a unit once while it
remembers it; new ones are laid end to end, as one text, and aligned by one product.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import ChainMap
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .shingles import chunks
from .token_counts import _byte_symbols

#: Units that a worker remembers, and their greatest length; beyond it starts anew, longer ones are aligned each time.
CACHE_UNITS = 150_000
CACHED_CHARS = 64
#: Pairs of ids, the most frequent ones, whose counts are broadcast (13 bytes each); links of others meet their counts in a join.
BROADCAST_PAIRS = 2_000_000
#: Different pairs whose counts a worker holds before it hands them on.
HELD_PAIRS = 1_000_000
#: New units that are one text to the piece model.
JOINED_UNITS = 64
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Csr:
    """Compressed sparse rows of zeros and ones: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @staticmethod
    def of_tokens(sizes: np.ndarray) -> Csr:
        """Tokens by bytes: token i covers the next ``sizes[i]`` bytes."""
        starts = np.concatenate(([0], np.cumsum(sizes)))
        return Csr(starts, np.arange(starts[-1]), int(starts[-1]))

    @staticmethod
    def of_groups(group: np.ndarray, n: int) -> Csr:
        """Tokens by groups: token i is in one group."""
        return Csr(np.arange(len(group) + 1), group, n)

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width)))), row[order], len(self.starts) - 1)

    def product_sizes(self, other: Csr) -> np.ndarray:
        """How many terms each row of the product with ``other`` sums."""
        terms = np.concatenate(([0], np.cumsum(np.diff(other.starts)[self.columns])))
        return terms[self.starts[1:]] - terms[self.starts[:-1]]

    def times(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gustavson's product: rows, columns and values of its entries. Row i sums the rows of ``other`` that it selects."""
        size = np.diff(other.starts)[self.columns]
        row = np.repeat(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), size)
        first = np.repeat(other.starts[:-1][self.columns], size)
        column = other.columns[first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)]
        key = row * max(other.width, 1) + column
        if len(key) and (key[1:] < key[:-1]).any():
            key = np.sort(key)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        return key[new] // max(other.width, 1), key[new] % max(other.width, 1), np.diff(np.concatenate((new, [len(key)])))


@dataclass
class Aligned:
    """Tokens of texts and their links. ``a`` and ``b`` are ids, ``a_text`` and ``b_text`` their texts' numbers, ``a_group`` and
    ``b_group`` their groups' (counted through all texts); ``link_a``, ``link_b`` number the linked tokens, ``shared`` their common bytes."""

    good: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    shared: np.ndarray

    def group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of an A and a B token of one group."""
        n = int(self.a_group[-1]) + 1 if len(self.a_group) else 0
        rows, columns, _ = Csr.of_groups(self.a_group, n).times(Csr.of_groups(self.b_group, n).transposed())
        return rows, columns


class Tokenizers:
    """The two vocabularies: a byte-level one (JSON, A) and one of pieces with byte fallback (model file, B)."""

    def __init__(self, byte_level: str, pieces: str):
        spec = json.loads(Path(byte_level).read_text())
        byte_of = {c: b for b, c in _byte_symbols().items()}
        added = {t["content"] for t in spec["added_tokens"]}
        token = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in added}
        self.encode_a = tiktoken.Encoding("aligned", pat_str=_PATTERN, mergeable_ranks={t: i for i, t in token.items()}, special_tokens={}).encode_ordinary
        self.a_bytes = [token.get(i, b"") for i in range(max(token) + 1)]
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"a piece goes across words: {piece!r}")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.width = len(self.b_bytes)
        self.units: dict[str, tuple] = {}

    def align(self, texts: list[str]) -> Aligned:
        """Tokens and links of each text with a space before it; a text that the tokens don't spell, or an empty one, is not ``good`` and has none."""
        spelt = [(" " + t).encode() for t in texts]
        a_ids = [self.encode_a(" " + t) if t else [] for t in texts]
        b_ids = self.model.encode(texts, num_threads=1) if texts else []
        get_a, get_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = np.array([bool(t) and b"".join(map(get_a, a)) == s == b"".join(map(get_b, b)) for t, s, a, b in zip(texts, spelt, a_ids, b_ids, strict=True)], dtype=bool)
        flat = lambda ids: np.array([i for k, one in enumerate(ids) if good[k] for i in one], dtype=np.int64)
        number = lambda ids: np.repeat(np.arange(len(texts)), [len(one) if good[k] else 0 for k, one in enumerate(ids)]) if texts else np.zeros(0, np.int64)
        return self._linked(good, flat(a_ids), flat(b_ids), number(a_ids), number(b_ids))

    def _linked(self, good: np.ndarray, a: np.ndarray, b: np.ndarray, a_text: np.ndarray, b_text: np.ndarray) -> Aligned:
        rows_a, rows_b = Csr.of_tokens(self.a_size[a]), Csr.of_tokens(self.b_size[b])
        link_a, link_b, shared = rows_a.times(rows_b.transposed())
        # tokens of both end at the ends of groups; texts end together too
        common = np.intersect1d(rows_a.starts[1:], rows_b.starts[1:], assume_unique=True)
        return Aligned(good, a, b, a_text, b_text, np.searchsorted(common, rows_a.starts[1:]), np.searchsorted(common, rows_b.starts[1:]), link_a, link_b, shared)

    def _joined(self, units: list[str], n_odd: int) -> Aligned | None:
        """The units, the last ``n_odd`` of which begin or end with white space, aligned as one text, without places in texts; None if that is not what the tokens spell."""
        plain = len(units) - n_odd
        texts = [*[" ".join(units[at : min(at + JOINED_UNITS, plain)]) for at in range(0, plain, JOINED_UNITS)], *units[plain:]]
        spelt = "".join([" " + t for t in texts])
        a_ids = [i for t in ([spelt[: len(spelt) - sum(len(u) + 1 for u in units[plain:])]] if plain else []) + [" " + u for u in units[plain:]] for i in self.encode_a(t)]
        b_ids = [i for one in self.model.encode(texts, num_threads=1) for i in one]
        spelt = spelt.encode()
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != spelt or b"".join(map(self.b_bytes.__getitem__, b_ids)) != spelt:
            return None
        none = np.zeros(0, np.int64)
        return self._linked(np.ones(len(units), bool), np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64), none, none)

    def _fresh(self, units: list[str]) -> dict[str, tuple]:
        """What is remembered of each unit: good, numbers of A and B tokens, groups and group links, its groups in text, and its links' pairs of ids as bytes."""
        odd = [u for u in units if u[0].isspace() or u[-1].isspace()]
        told = units if not odd else [*set(units).difference(odd), *odd]
        if "\u2581" in " ".join(units):  # a piece has a space in its place
            told, odd = [u for u in told if "\u2581" not in u], [u for u in odd if "\u2581" not in u]
        found = self._joined(told, len(odd)) if told else None
        if told and found is None:
            one_by_one = self.align(told)
            told = [u for u, good in zip(told, one_by_one.good.tolist(), strict=True) if good]
            found = self._linked(one_by_one.good[one_by_one.good], one_by_one.a, one_by_one.b, one_by_one.a_text, one_by_one.b_text)
        out = dict.fromkeys(units, (False, 0, 0, 0, 0, "", b""))
        if not told:
            return out
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, map(str.encode, told)), np.int64, len(told)) + 1)))
        a_ends, b_ends = np.cumsum(self.a_size[found.a]), np.cumsum(self.b_size[found.b])
        a_at, b_at = np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right")
        link_at = np.searchsorted(found.link_a, a_at)
        codes = (found.a[found.link_a] * self.width + found.b[found.link_b]).astype("<i4").tobytes()
        group_at = np.append(found.a_group, found.a_group[-1] + 1)[a_at]
        in_group = np.concatenate(([0], np.cumsum(np.bincount(found.a_group) * np.bincount(found.b_group))))[group_at]
        text, item_at = self._group_text(found)
        text_at = item_at[a_at + b_at]
        columns = [np.diff(x).tolist() for x in (a_at, b_at, group_at, in_group)]
        t, c = text_at.tolist(), (4 * link_at).tolist()
        for k, row in enumerate(zip(told, *columns, strict=True)):
            out[row[0]] = (True, *row[1:], text[t[k] : t[k + 1] - 1], codes[c[k] : c[k + 1]])
        return out

    def _group_text(self, found: Aligned) -> tuple[str, np.ndarray]:
        """Ids of groups as ``a1,a2|b1;`` one after the other, and where each token's begins; tokens are in order of group, those of A first."""
        n = len(found.a) + len(found.b)
        a_place = np.arange(len(found.a)) + np.searchsorted(found.b_group, found.a_group, "left")
        b_place = np.arange(len(found.b)) + np.searchsorted(found.a_group, found.b_group, "right")
        ids, mark = np.empty(n, np.int64), np.empty(n, np.uint8)
        for place, one, group, last in ((a_place, found.a, found.a_group, "|"), (b_place, found.b, found.b_group, ";")):
            ids[place] = one
            mark[place] = np.where(np.append(group[1:] != group[:-1], True), ord(last), ord(","))
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, len(str(max(len(self.a_bytes), self.width)))))
        end = np.cumsum(digits + 1)
        out = np.empty(int(end[-1]), np.uint8)
        out[end - 1] = mark
        rest, at, left = ids, end - 2, digits
        while len(rest):
            out[at] = 48 + rest % 10
            on = left > 1
            rest, at, left = rest[on] // 10, at[on] - 1, left[on] - 1
        return out.tobytes().decode("ascii"), np.concatenate(([0], end))

    def split(self, texts: list[str | None]) -> tuple[list[list[str]], Mapping[str, tuple]]:
        """Units of each text, and what is known of each unit."""
        split = [_CUT.split(t) if t else [] for t in texts]
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        new = list({u for units in split for u in units if u not in self.units})
        known = self.units
        if new:
            fresh = self._fresh(new)
            if max(map(len, new)) > CACHED_CHARS:
                long = {u: fresh.pop(u) for u in new if len(u) > CACHED_CHARS}
                known = ChainMap(self.units, long)
            self.units.update(fresh)
        return split, known


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _load(byte_level: str, pieces: str) -> Tokenizers:
    if (byte_level, pieces) not in _LOADED:
        _LOADED[byte_level, pieces] = Tokenizers(byte_level, pieces)
    return _LOADED[byte_level, pieces]


_ROW_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_group_links")], ("groups_sha256", pa.string()), ("codes", pa.binary()), ("pair", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, codes binary, pair array<int>, n array<long>"


def _pairs(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row for each document, with the pair of ids (A id times the number of B ids, plus B id) of each link, and
    rows with ``pair`` and ``n`` that count pairs: each holds what a worker has counted."""
    nothing = pa.array([None], pa.int64())

    def run(batches):
        both = _load(byte_level, pieces)
        if len(both.a_bytes) * both.width >= 1 << 31:
            raise ValueError("pairs of ids need more than 31 bits")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            different, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return different, np.bincount(at, np.concatenate([n for _, n in held]), len(different)).astype(np.int64)

        def counted(pair: np.ndarray, n: np.ndarray):
            parts = [nothing] + [nothing] * 5 + [pa.array([None], pa.string()), pa.array([None], pa.binary()), pa.array([pair], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(parts, schema=_ROW_SCHEMA)

        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                split, known = both.split(texts[a:b])
                rows = []
                for units in split:
                    found = [known[u] for u in units]
                    if not found or not all([f[0] for f in found]):
                        rows.append((0, 0, 0, 0, 0, "", b""))
                        continue
                    _, n_a, n_b, n_groups, in_group, groups, codes = zip(*found, strict=True)
                    codes = b"".join(codes)
                    rows.append((sum(n_a), sum(n_b), sum(n_groups), len(codes) // 4, sum(in_group), hashlib.sha256(";".join(groups).encode()).hexdigest(), codes))
                every = np.frombuffer(b"".join([r[-1] for r in rows]), dtype="<i4")
                held.append(np.unique(every, return_counts=True))
                if sum(len(p) for p, _ in held) > HELD_PAIRS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield counted(*held[0])
                        held = []
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(_ROW_SCHEMA)[1:8], strict=True)]
                empty = [pa.nulls(b - a, f.type) for f in list(_ROW_SCHEMA)[8:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, *empty], schema=_ROW_SCHEMA)
        if held:
            yield counted(*merged())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


_JUDGED = "row long, n_best long, count_sum long, rest array<int>, rest_n array<long>"


def align_documents(docs: DataFrame, byte_level: str, pieces: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Alignment of every whole text under two vocabularies, by their paths on every executor.

    Returns doc_id, n_a and n_b (tokens), n_groups, n_links (overlaps), n_best (links whose pair of ids is counted in as
    many links of all texts as any pair of its B id), count_sum (those counts over the links), groups_sha256 and
    n_group_links (pairs of tokens that share a group). Null and empty texts, and those
    that the tokens don't spell byte by byte, have zeros and an empty string. A null doc_id is carried along, repeated
    rows stay and count, other columns are ignored, an empty table gives an empty result.

    Texts are read once, in slices; a longer one is a slice of its own. The links of each text go to a table as pairs of
    ids and meet the corpus-wide counts of pairs from there: of the ``broadcast_pairs`` most frequent by a
    broadcast, of the rest by a join of each row's different pairs. There are at most as many pairs as both vocabularies allow.
    """
    found = materialize(_pairs(docs, byte_level, pieces).withColumn("row", F.monotonically_increasing_id()), "align-rows", compression="zstd")
    width = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    each = found.where("pair is not null").select(F.explode(F.arrays_zip("pair", "n")).alias("z"))
    counted = materialize(each.groupBy(F.col("z.pair").alias("pair")).agg(F.sum("z.n").alias("n")), "align-pairs")
    top = counted.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("top"))  # a row for each B id at most
    counted = materialize(counted.join(F.broadcast(top), F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "align-counts")
    least = 0
    if counted.count() > broadcast_pairs:  # the count from which on pairs fit
        by_count, held = counted.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.col("n").desc()).limit(broadcast_pairs), 0
        for row in by_count.toLocalIterator():
            held += row["pairs"]
            if held > broadcast_pairs:
                least = row["n"] + 1
                break
    often = counted.where(F.col("n") >= least).orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("pair", "n", "best")))

    def judge(batches):
        schema = pa.schema([*list(_ROW_SCHEMA)[:7], ("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", pa.list_(pa.int32())), ("rest_n", pa.list_(pa.int64()))])
        pairs, counts, best = shared.value
        total = lambda values, ends: np.diff(np.concatenate(([0], np.cumsum(values)))[ends])
        for batch in small_batches(batches):
            codes = batch.column("codes").to_pylist()
            every = np.frombuffer(b"".join(codes), dtype="<i4")
            ends = np.cumsum([0, *[len(c) // 4 for c in codes]])
            at = np.minimum(np.searchsorted(pairs, every), max(len(pairs) - 1, 0))
            there = pairs[at] == every if len(pairs) else np.zeros(len(every), bool)
            rest = [((), ())] * len(codes)
            if not there.all():
                rest = [np.unique(every[i:j][~there[i:j]], return_counts=True) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            n = np.where(there, counts[at], 0) if len(pairs) else np.zeros(len(every), np.int64)
            n_best = total(there & best[at], ends) if len(pairs) else np.zeros(len(codes), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], batch.column("row"), pa.array(n_best), pa.array(total(n, ends)), pa.array([r[0] for r in rest], pa.list_(pa.int32())), pa.array([r[1] for r in rest], pa.list_(pa.int64()))], schema=schema)

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256"]
    judged = found.where("codes is not null").select(*columns, "row", "codes").mapInArrow(judge, _ROW.split(", codes")[0] + ", " + _JUDGED)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    if not least:
        return judged.select(names)
    judged = materialize(judged, "align-judged")
    rest = judged.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("z")).select("row", F.col("z.rest").alias("pair"), F.col("z.rest_n").alias("times"))
    rest = rest.join(counted.where(F.col("n") < least).hint("merge"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    judged = judged.join(rest.hint("merge"), "row", "left")
    return judged.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0))).select(names)


def token_links(docs: DataFrame, byte_level: str, pieces: str, shared_groups: bool = False) -> DataFrame:
    """The links themselves: doc_id, a and b (places of the tokens in their text), a_id, b_id and n_bytes, the bytes they share.

    With ``shared_groups`` all pairs of tokens of a group, of which those that don't overlap share no bytes.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("a", "b", "a_id", "b_id", "n_bytes")]])

    def run(batches):
        both = _load(byte_level, pieces)
        for batch in small_batches(batches):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(texts):
                found = both.align(texts[i:j])
                first_a, first_b = (np.searchsorted(t, np.arange(j - i)) for t in (found.a_text, found.b_text))
                a, b, n = found.link_a, found.link_b, found.shared
                if shared_groups:
                    bytes_of = dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True))
                    a, b = found.group_links()
                    n = np.array([bytes_of.get(x, 0) for x in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
                text = found.a_text[a]
                columns = [ids.slice(i, j - i).take(pa.array(text)), *[pa.array(x.astype(np.int64)) for x in (a - first_a[text], b - first_b[text], found.a[a], found.b[b], n)]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, a long, b long, a_id long, b_id long, n_bytes long")
