"""Word shingles of whole batches of texts as numpy arrays.

Words are runs of ASCII letters and digits and of code points from U+0080 on, lower-cased. A word
hash is a polynomial of its UTF-8 bytes, taken from prefix sums, so that no Python code runs per
word; five mixed word hashes make a shingle's 64-bit hash.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None]):
    """Slices of the texts of about CHUNK_BYTES each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and held + n > CHUNK_BYTES // 2:
            yield start, i
            start, held = i, 0
        held += n
    if texts:
        yield start, len(texts)


def shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order and the offsets of each text's; a text of fewer words has one.

    A text without words, or null, has none. Hashes repeat where shingles do.
    """
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    first, last = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), dtype=np.uint64)))
    words = mix((sums[last] - sums[first]) * _power(_INVERSE, len(data) + 1)[first])
    begin = np.searchsorted(first, at[:-1])
    end = np.searchsorted(first, at[1:])
    n_words = end - begin
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    start = np.repeat(begin - offsets[:-1], counts) + np.arange(offsets[-1])
    padded = np.concatenate((words, np.zeros(width, dtype=np.uint64)))
    total = np.zeros(len(start), dtype=np.uint64)
    short = np.repeat(np.where(n_words < width, n_words, width), counts)
    for j in range(width):
        term = padded[start + j] * factor[j]
        total += term if (short >= width).all() else np.where(j < short, term, np.uint64(0))
    return mix(total), offsets


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
