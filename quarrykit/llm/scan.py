"""Whole texts of an Arrow column, cut into words and hashed with numpy.

Word classes are sets of bytes. A UTF-8 lead or continuation byte is 0x80 or
above, so a class given over ASCII and "all else" is exact on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; two tables of this many 64-bit powers are kept by each worker.
PIECE = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but the line feed
LINES = np.ones(256, bool)
LINES[10] = False


class Words(NamedTuple):
    """Of all words in order: first and end byte, hash, row; of all rows: the first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or _powers[0].size < n:
        n = max(n, PIECE + (PIECE >> 3))
        _powers[:] = []
        for base in (_BASE, _UNBASE):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def folded(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The hash of a sequence and one more hash."""
    return mixed(h * np.uint64(0x2545F4914F6CDD1D) + following)


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows together and len + 1 offsets into them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words_of(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    """The words of every row; ``inside`` says which bytes are in words, ``lower`` folds A-Z."""
    values = _BYTE_LOWER if lower else _BYTE
    starts, ends, hashes = [], [], []
    at, size = 0, buf.size
    while at < size:
        to = min(size, at + PIECE)
        while to < size and inside[buf[to - 1]] and inside[buf[to]]:  # not inside a word, unless a row ends here
            rest = np.flatnonzero(~inside[buf[to : to + PIECE]])
            border = offsets[min(np.searchsorted(offsets, to), offsets.size - 1)]
            to = min(border, to + (int(rest[0]) if rest.size else min(PIECE, size - to)))
            if to == border:
                break
        piece = buf[at:to]
        word = inside[piece]
        borders = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to)] - at
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[borders] = word[borders]
        last[borders - 1] = word[borders - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, back = _power_tables(piece.size + 1)
        total = np.zeros(piece.size + 1, np.uint64)
        np.cumsum(values[piece] * power[: piece.size], out=total[1:])
        hashes.append(mixed((total[e] - total[s]) * back[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first_word = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(offsets.size - 1), np.diff(first_word))
    return Words(start, end, hashed, row, first_word)


def shingles_of(words: Words, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and of all rows their first shingle (one more at the end).

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    h = words.hash if hashes is None else hashes
    count = np.diff(words.first)
    number = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(number)])
    rows = np.repeat(np.arange(count.size), number)
    begin = words.first[:-1][rows] + np.arange(first[-1]) - first[:-1][rows]
    length = np.minimum(count[rows], k)
    out = mixed(h[begin] + length.astype(np.uint64))
    for j in range(1, k):
        more = length > j
        out[more] = folded(out[more], h[begin[more] + j])
    return out, first


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows, and of bytes unless one row alone has more."""
    lengths = np.diff(buffer_of(batch.column(column))[1])
    total, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(total, base + most_bytes, "right"))), at + most_rows)
        yield batch.slice(at, to - at)
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
