"""Harmonic packing of tokenized documents into sequences of a fixed size.

A worker packs the documents of its slice alone. Full sequences are cut off
first. What is left of a document belongs to the class k if k of it fit into a
sequence and k + 1 don't; each bin of a class takes k documents. Documents of
the smallest classes, and those that make no whole bin, are cut to fill the gaps
of the bins. Only the last tokens of a slice make sequences that aren't full;
they are cut to powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrykit.llm import scan, tokens

#: Tokens of a sequence, a power of two.
SIZE = 4096
#: The first class whose documents fill gaps.
SMALL = 8
#: Tokens that are packed at once, about; they take 16 MB.
SLICE = 1 << 22

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Pieces(NamedTuple):
    """Parts of items in the order of their places: the item, its first token, length, sequence and offset there."""

    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def _bins(lengths: np.ndarray, size: int, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items of 1 to size tokens: the item and bin of each that is in a bin, and the others."""
    kind = size // lengths
    order = np.argsort(kind, kind="stable")
    order = order[kind[order] < small]
    rank = np.arange(order.size) - np.searchsorted(kind[order], kind[order])
    whole = np.bincount(kind[order], minlength=small + 1) // np.maximum(np.arange(small + 1), 1)
    inside = rank // kind[order] < whole[kind[order]]
    first = np.cumsum(whole) - whole  # bins of the classes before
    bins = (first[kind[order]] + rank // kind[order])[inside]
    others = np.ones(lengths.size, bool)
    others[order[inside]] = False
    return order[inside], bins, np.flatnonzero(others)


def packed(lengths: np.ndarray, size: int = SIZE, small: int = SMALL) -> Pieces:
    """Pieces of all items of one token or more; sequences count from 0. All but the last ones, whose lengths are falling powers of two, are full."""
    full, rest = lengths // size, lengths % size
    item, total = np.flatnonzero(rest), int(full.sum())
    own = np.repeat(np.arange(lengths.size), full)
    nth = np.arange(total) - np.repeat(np.cumsum(full) - full, full)
    wholes = (own, nth * size, np.full(total, size), np.arange(total), np.zeros(total, np.int64))

    left = rest[item]
    inside, bins, others = _bins(left, size, small) if item.size else (np.zeros(0, np.int64),) * 3
    used = np.bincount(bins, left[inside]).astype(np.int64) if bins.size else np.zeros(0, np.int64)
    # A bin that is given up turns its gap into no need and its documents into filling: a sequence more of it for each.
    lacking = int((size - used).sum()) - int(left[others].sum())
    keep = np.ones(used.size, bool)
    if lacking > 0:
        keep[np.argsort(used, kind="stable")[: min(used.size, -(-lacking // size))]] = False
    others = np.concatenate([others, inside[~keep[bins]]]) if bins.size else others
    inside, bins = (inside[keep[bins]], bins[keep[bins]]) if bins.size else (inside, bins)
    number = np.cumsum(keep) - 1
    bins, used = number[bins] if bins.size else bins, used[keep]
    order = np.argsort(bins, kind="stable")
    inside, bins = inside[order], bins[order]
    before = np.cumsum(left[inside]) - left[inside]
    start_of = np.zeros(used.size, np.int64)
    start_of[1:] = np.cumsum(used)[:-1]
    kept = (item[inside], full[item[inside]] * size, left[inside], total + bins, before - start_of[bins])

    # What fills: a line of tokens, cut where a document or a room ends.
    amount = left[others]
    line = int(amount.sum())
    gaps = size - used
    beyond = line - int(gaps.sum())
    tail = beyond % size
    rooms = np.concatenate([gaps, np.full(beyond // size, size), [1 << b for b in range(size.bit_length() - 1, -1, -1) if tail >> b & 1]]).astype(np.int64)
    offsets = np.concatenate([used, np.zeros(rooms.size - used.size, np.int64)])
    ends, room_ends = np.cumsum(amount), np.cumsum(rooms)
    cuts = np.union1d(ends, room_ends[rooms > 0]).astype(np.int64)
    begins = np.concatenate([[0], cuts[:-1]])[: cuts.size]
    which, room = np.searchsorted(ends, begins, "right"), np.searchsorted(room_ends, begins, "right")
    inner = begins - (ends - amount)[which]
    filling = (item[others[which]], full[item[others[which]]] * size + inner, cuts - begins, total + room, offsets[room] + begins - (room_ends - rooms)[room])
    return Pieces(*(np.concatenate(x).astype(np.int64) for x in zip(wholes, kept, filling, strict=True)))


def _packing(path: str, last: int, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.word_ids(path).encode
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, its tokens, those before these, ids

        def put(final: bool) -> pa.RecordBatch:
            nonlocal sequence, held
            p = packed(np.array([x[3].size for x in held], np.int64), size)
            place = p.sequence
            # Sequences that aren't full wait for what comes, but for the last.
            open_ = (np.bincount(place, p.length)[place] < size) & (not final)
            crc, base = np.zeros(place.size, np.int64), np.array([x[2] for x in held], np.int64)
            for i, (item, start, length) in enumerate(zip(p.item.tolist(), p.start.tolist(), p.length.tolist(), strict=True)):
                crc[i] = zlib.crc32(held[item][3][start : start + length].tobytes())
            done = ~open_
            columns = [pa.array([held[i][0] for i in p.item[done].tolist()], pa.int64())]
            columns += [pa.array(x[done]) for x in (base[p.item] + p.start, p.length, crc, np.array([x[1] for x in held], np.int64)[p.item], place + sequence, p.offset)]
            rest = [(held[i][0], held[i][1], held[i][2] + s, held[i][3][s : s + n].copy()) for i, s, n in zip(p.item[open_].tolist(), p.start[open_].tolist(), p.length[open_].tolist(), strict=True)]
            sequence += int(place[done].max()) + 1 if done.any() else 0
            held = rest
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        waiting = 0
        for batch in batches:
            for part in scan.slices(batch, "text"):
                texts = part.column("text").fill_null("").to_pylist()
                for name, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(last)).astype("<u4")
                    held.append((name, ids.size, 0, ids))
                    waiting += ids.size
                if waiting >= most:
                    yield put(False)
                    waiting = sum(x[3].size for x in held)
        if held:
            yield put(True)

    return run


def pack(docs: DataFrame, tokenizer: str, last: int = 2, size: int = SIZE, most: int = SLICE) -> DataFrame:
    """The pieces of all documents(doc_id, text) in sequences of ``size`` tokens, a row for each.

    A document's tokens are those of the tokenizer's file, without special tokens,
    and then the id ``last``; null and empty texts have that one alone, and a
    text of any length is packed whole. Rows are packed as they are: repeated
    ones, and such with a null doc_id, too. Each task packs ``most`` tokens at a
    time, so nothing moves between tasks and memory is bounded by that and the
    longest text; all its sequences are full, but for at most twelve at the end,
    whose lengths are powers of two. ``sequence_id`` has the task in its upper
    bits. Other columns don't matter.
    """
    return docs.select("doc_id", "text").mapInArrow(_packing(tokenizer, last, size, most), PIECES)
