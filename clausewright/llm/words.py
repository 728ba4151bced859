"""Words of many texts at once, and 64-bit hashes of them, computed on the bytes of an Arrow column.

Everything here works on one Arrow batch inside a task. A text that is null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are hashed together: small enough for the arrays to stay in cache.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of the sequence whose halves hash to a and b."""
    return mix(a * U(0xD6E8FEB86659FD93) + b)


def letters(spaces: bytes = b" \t\n\x0b\x0c\r") -> np.ndarray:
    table = np.ones(256, bool)
    table[list(spaces)] = False
    return table


#: Bytes of `[^\x20\x09-\x0D]+`
BLANK_SEPARATED = letters()
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` before A-Z are lower-cased
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

#: A byte's number by lane. Lanes hash alike but from other numbers, so that two together make 128 bits.
_EXACT = [mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407) + U(k << 60)) for k in (0, 1)]
_FOLDED = [table.copy() for table in _EXACT]
for _table, _exact in zip(_FOLDED, _EXACT, strict=True):
    _table[65:91] = _exact[97:123]


def _hashed(total: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """The hash of bytes from the sum of their numbers; the length keeps words of summands that cancel apart."""
    return mix(total + np.asarray(length).astype(U) * U(0x9FB21C651E98DF25))


@dataclass
class Words:
    """start, end: bytes of each word in the piece; hash: of its bytes; first: for each text, and once more, its first word's number.

    sums: running sums of numbers that each depend on a byte and its place in its word, and not linearly on
    either: sums of powers, say, would take long words of a certain build for each other.
    """

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def heads(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes of words that are longer, and those words' numbers."""
        long = np.flatnonzero(self.end - self.start > n)
        at = self.start[long]
        return _hashed(self.sums[at + n] - self.sums[at], n), long

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = BLANK_SEPARATED, fold: bool = False, lane: int = 0) -> Words:
    """bounds: where each text begins in data, and where the last ends. fold: A-Z count as a-z. lane: 0 or 1."""
    inside = table[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    full = bounds[:-1][np.diff(bounds) > 0]
    before[full] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[full[full > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    place = np.arange(len(data), dtype=U)
    begun = np.zeros(len(data), U)
    begun[start] = start
    place -= np.maximum.accumulate(begun)
    number = (_FOLDED if fold else _EXACT)[lane][data] + place * U(0x9E3779B97F4A7C15)
    number = (number ^ (number >> U(32))) * U(0xD6E8FEB86659FD93)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(number ^ (number >> U(29)), out=sums[1:])
    return Words(start, end, _hashed(sums[end] - sums[start], end - start), np.searchsorted(start, bounds), sums)


def grams(one: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, by doubling; windows run across texts, so take those that end in their text."""
    have, length, out, done = one, 1, None, 0
    while True:
        if n & length:
            out = have if out is None else pair(out[: max(0, len(out) - length)], have[done : done + max(0, len(out) - length)])
            done += length
        if done == n:
            return out[: max(0, len(one) - n + 1)]
        have = pair(have[: max(0, len(have) - length)], have[length:])
        length *= 2


def starts(words: Words, n: int) -> np.ndarray:
    """Numbers of the words at which n words of one text start."""
    counts = words.counts - n + 1
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return np.zeros(0, np.int64)
    c = counts[full]
    return np.repeat(words.first[full] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())


def column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its texts."""
    values = batch.column(name)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values, "")
    wide = pa.types.is_large_string(values.type)
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, len(values) + 1, values.offset * (8 if wide else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, bounds - bounds[0]


def pieces(data: np.ndarray, bounds: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits texts into runs of about limit bytes, whole texts each: (first text, text after the last, bytes, bounds)."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to
