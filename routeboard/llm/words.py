"""Words, word hashes and rolling window hashes shared by the operators.

A word is a maximal run of characters other than space and ``\\x09-\\x0D``
(on UTF-8 bytes that is exactly ``bytes.split()``); matching is byte exact.
Hashes are 64 bits wide: two different windows collide with probability about
``2**-64``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: the same words as a pattern for Spark SQL and DuckDB
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
NEAR_WORDS = 5                 # words in a shingle
NEAR_PERCENT = 75              # near duplicates: intersection >= 75 % of the union
CACHED_WORDS = 300_000         # word hashes one Python worker remembers

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LENGTH = 0xD1B54A32D192ED03
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it in any case."""
    while name.lower() in map(str.lower, columns):
        name = "_" + name
    return name


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased (no other letter changes)."""
    return text.encode().lower().split() if text else []


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = h
        return h


_known = _WordHashes()


def forget_words() -> None:
    """Empties this worker's memory of word hashes."""
    _known.clear()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        table = np.full(max(n, 4096), base, np.uint64)
        table[0] = 1
        _powers[kind] = np.cumprod(table, dtype=np.uint64)
    return _powers[kind][:n]


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64) of every ``width`` consecutive values of ``h``."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _power("up", _BASE, n), out=prefix[1:])
    rolled = (prefix[width:] - prefix[:-width]) * _power("down", _INVERSE, n - width + 1)
    return mix(rolled + np.uint64(width * _LENGTH % 2**64))


def shingle_set(text: str | None, width: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of the lower-cased text.

    Fewer words than ``width``: the whole sequence is the one shingle.  No
    word (or NULL): empty.
    """
    h = word_hashes(lower_words(text))
    return np.unique(window_hashes(h, min(width, len(h)))) if len(h) else h


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most ``limit`` bytes in ``column``; a longer value is a run of its own."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
