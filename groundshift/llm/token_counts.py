"""Token counts by rank-synchronous merging of ragged arrays of symbols.

A batch's distinct pre-tokens are laid out as one array of symbol ids with row offsets. In every
round each sequence merges all its non-overlapping pairs of its own lowest rank at once, until no
sequence has a pair with a rank; what survives is counted.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKEN_LIMIT = 2048
#: Distinct pre-tokens whose counts a Python worker remembers; beyond it starts anew.
CACHE_WORDS = 200_000
_NONE = np.int32(2**31 - 1)


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)}


class WordBpe:
    """Counts of a lower-casing, word-end BPE vocabulary file (JSON of the public tokenizers)."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.normalizer = Tokenizer.from_file(path).normalizer  # NFC, white space, lower case
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = _byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([vocab[symbols[b] + suffix] for b in range(256)], dtype=np.int32)
        left, right = (np.array([vocab[m[i]] for m in model["merges"]], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int32)
        self.width = len(vocab)
        keys = left * self.width + right
        self.made = made
        self._fill(keys)
        self.cache: dict[str, int] = {}

    def _fill(self, keys: np.ndarray) -> None:
        """An open hash table of the pairs: slot_key, slot_rank; the probes run to the next empty slot."""
        self.shift = np.uint64(64 - 18)
        self.slot_key = np.full(1 << 18, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << 18, _NONE, dtype=np.int32)
        for rank, (slot, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist(), strict=True)):
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) & 0x3FFFF
            self.slot_key[slot], self.slot_rank[slot] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        slot, out, where = self._slot(key), np.full(len(key), _NONE, dtype=np.int32), np.arange(len(key))
        while len(key):
            there = self.slot_key[slot]
            same = there == key
            out[where[same]] = self.slot_rank[slot[same]]
            on = np.flatnonzero(~same & (there >= 0))
            key, where, slot = key[on], where[on], (slot[on] + 1) & 0x3FFFF
        return out

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Number of symbols each pre-token ends with."""
        coded = [w.encode() for w in words]
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        ends = np.cumsum(size) - 1
        symbol = self.inner[data]
        symbol[ends] = self.final[data[ends]]
        row = np.repeat(np.arange(len(coded)), size)
        count = size.copy()
        rank = np.full(len(symbol), _NONE, dtype=np.int32)  # of the pair that starts here
        inside = np.flatnonzero(row[:-1] == row[1:])
        rank[inside] = self._rank(symbol[inside], symbol[inside + 1])
        while True:
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
            if not len(first):
                return count
            low = np.minimum.reduceat(rank, first)
            alive = low != _NONE
            if not alive.all():  # finished sequences leave the array
                keep = np.repeat(alive, np.diff(np.concatenate((first, [len(row)]))))
                count[row[first[~alive]]] = np.diff(np.concatenate((first, [len(row)])))[~alive]
                symbol, row, rank = symbol[keep], row[keep], rank[keep]
                if not len(row):
                    return count
                low, first = low[alive], np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            length = np.diff(np.concatenate((first, [len(row)])))
            hit = rank == np.repeat(low, length)
            # of touching hits (a run of one symbol) every second one merges
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():
                run = np.cumsum(np.concatenate(([True], np.diff(at) != 1)))
                nth = np.arange(len(at)) - np.flatnonzero(np.concatenate(([True], np.diff(run) != 0)))[run - 1]
                at = at[nth % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stay = np.ones(len(row), dtype=bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            at = moved[at]
            symbol, row, rank = symbol[stay], row[stay], rank[stay]
            touched = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[touched] = _NONE
            pair = touched[touched + 1 < len(row)]
            pair = pair[row[pair] == row[pair + 1]]
            rank[pair] = self._rank(symbol[pair], symbol[pair + 1])

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special tokens in it."""
        parts = self.special.split(text) if self.special else [text]
        found: list[str] = []
        for part in parts:
            if not part.isascii():
                found += self.pattern.findall(self.normalizer.normalize_str(part))
            else:
                found += self.pattern.findall(part.lower())
        return found, len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.pretokens(t or "") for t in texts]
        new = {w for words, _ in split for w in words if w not in self.cache}
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = {w for words, _ in split for w in words}
        if new:
            fresh = sorted(new)
            self.cache.update(zip(fresh, self.merge_counts(fresh).tolist(), strict=True))
        get = self.cache.__getitem__
        return [sum(map(get, words)) + specials for words, specials in split]


_LOADED: dict[str, WordBpe] = {}
_COUNTS = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``vocabulary`` is the path of the vocabulary file on every executor. Null and empty texts have
    no bytes and no tokens; a null doc_id is carried along, repeated rows stay, other columns are
    ignored, an empty table gives an empty result. Texts run through in slices of about half a
    million characters; a longer text is a slice of its own. There is no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        from .shingles import chunks

        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = WordBpe(vocabulary)
        bpe = _LOADED[vocabulary]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                part = texts[a:b]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in part], pa.int64()), pa.array(bpe.count(part), pa.int64())], schema=schema)

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _COUNTS)
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
