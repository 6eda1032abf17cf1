"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment covers a bounded slice of the
corpus and holds, for each term that some test item has, the sorted list of its
positions; a filter of fixed size leaves the other terms out. Positions of
different documents are further apart than a window is long. Test items come in
blocks of bounded size. For each window of a block the lists of its terms,
shifted by their offsets, are intersected in order of rarity in the corpus.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan
from quarrykit.llm.store import written

#: Test words in a block, about: an item is in one block whole. A window has six bytes for each of its words, so a block takes 60 MB.
BLOCK_WORDS = 1_000_000
#: Test words in a row of the table of items; rows of an item overlap so that every window is in one.
PIECE_WORDS = 20_000
#: The filter of terms that are worth a posting has a fixed size of 2^23 bits.
FILTER_SHIFT = np.uint64(41)
#: Terms of an item that must stand together for a proximity match.
NEAR_TERMS = 3

ITEM = "item_id string, terms array<long>"
SEGMENT = "segment string, doc_ids array<long>, n_words array<long>, terms array<long>, starts array<int>, positions binary"
HITS = "segment string, place int, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>, near array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long, spans array<struct<start:long,end:long>>"


def _items(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.slices(batch, "text"):
                words = scan.words_of(*scan.buffer_of(part.column("text")), scan.ALNUM, True)
                ids, terms = [], []
                for name, a, b in zip(part.column("item_id").to_pylist(), words.first[:-1], words.first[1:], strict=True):
                    for at in range(a, max(a + 1, b - window + 1) if b > a else a, PIECE_WORDS):
                        ids.append(name)
                        terms.append(scan.signed(words.hash[at : min(b, at + PIECE_WORDS + window - 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])

    return run


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << 23, bool)
    for batch in batches:
        bits[(batch.column("terms").flatten().to_numpy().view(np.uint64) >> FILTER_SHIFT).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _index(term_filter, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = np.unpackbits(term_filter.value).astype(bool)
        for batch in batches:
            for part in scan.slices(batch, "text"):
                words = scan.words_of(*scan.buffer_of(part.column("text")), scan.ALNUM, True)
                keep = listed[(words.hash >> FILTER_SHIFT).astype(np.int64)]
                position = (np.arange(words.hash.size) + words.row * gap)[keep]
                terms = scan.signed(words.hash[keep])
                order = np.argsort(terms, kind="stable")
                terms, position = terms[order], position[order].astype(np.int64)
                own, starts = np.unique(terms, return_index=True)
                row = [uuid.uuid4().hex, part.column("doc_id").to_pylist(), np.diff(words.first), own, np.append(starts, terms.size).astype(np.int32)]
                kinds = [pa.string(), *(pa.list_(x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                # 32-bit positions unless one document alone goes beyond.
                wide = position.size and int(position.max()) >= 2**31
                columns = [pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)]
                columns.append(pa.array([position.astype(np.int64 if wide else np.int32).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["segment", "doc_ids", "n_words", "terms", "starts", "positions"])

    return run


class _Block(NamedTuple):
    """A block of test items; windows and items refer to terms by their place in ``vocabulary``."""

    vocabulary: np.ndarray
    names: list[str]
    item: np.ndarray  # of each window
    length: np.ndarray  # of each window
    terms: np.ndarray  # of each window, rarest first; -1 beyond its length
    shifts: np.ndarray
    rarest: np.ndarray  # of each item, a few distinct terms; -1 beyond


def _padded(x: np.ndarray, width: int, kind: type) -> np.ndarray:
    return np.pad(x.astype(kind), ((0, 0), (0, width - x.shape[1])), constant_values=-1)


def _block(rows: list, counts: dict[int, int], window: int) -> _Block:
    vocabulary = np.unique(np.concatenate([np.asarray(r.terms, np.int64) for r in rows]))
    rarity = np.array([counts.get(int(t), 0) for t in vocabulary], np.int64)
    names = sorted({r.item_id for r in rows})
    number = {name: i for i, name in enumerate(names)}
    item, length, terms, shifts = [], [], [], []
    distinct: list[list[np.ndarray]] = [[] for _ in names]
    for r in rows:
        own = np.searchsorted(vocabulary, np.asarray(r.terms, np.int64))
        distinct[number[r.item_id]].append(own)
        n = min(window, own.size)
        windows = np.lib.stride_tricks.sliding_window_view(own, n)
        order = np.argsort(rarity[windows], axis=1, kind="stable")
        terms.append(_padded(np.take_along_axis(windows, order, 1), window, np.int32)), shifts.append(_padded(order, window, np.int16))
        item.append(np.full(len(windows), number[r.item_id], np.int32)), length.append(np.full(len(windows), n, np.int32))
    rarest = np.full((len(names), NEAR_TERMS), -1, np.int32)
    for i, parts in enumerate(distinct):
        own = np.unique(np.concatenate(parts))
        own = own[np.argsort(rarity[own], kind="stable")][:NEAR_TERMS]
        rarest[i, : own.size] = own
    return _Block(vocabulary, names, *map(np.concatenate, (item, length, terms, shifts)), rarest)


def _counted(vocabulary):
    """Occurrences of a block's terms, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        total = np.zeros(terms.size + 1, np.int64)
        for batch in batches:
            for own, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                at = np.searchsorted(own := own.values.to_numpy(), terms)
                there = at < own.size
                there[there] = own[at[there]] == terms[there]
                total[:-1][there] += np.diff(starts.values.to_numpy())[at[there]]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(total[:-1], pa.int64())], ["term", "n"])

    return run


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), sorted_values.size - 1)
    return sorted_values[at] == x


def _matches(block, gap: int, slop: int, every: bool):
    """Of each segment its documents with what of the block is in them; without ``every``, only those that hold something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Block = block.value
        for batch in batches:
            for row in range(batch.num_rows):
                own, cuts, n_words = (batch.column(c)[row].values.to_numpy() for c in ("terms", "starts", "n_words"))
                raw = batch.column("positions")[row].as_buffer()
                positions = np.frombuffer(raw, np.int32 if not own.size or raw.size == 4 * cuts[-1] else np.int64).astype(np.int64)
                begins = np.concatenate([[0], np.cumsum(n_words)[:-1]]) + np.arange(n_words.size) * gap
                place = np.searchsorted(own, known.vocabulary)
                there = place < own.size
                there[there] = own[place[there]] == known.vocabulary[there]

                def listed(term: int, place=place, cuts=cuts, positions=positions) -> np.ndarray:
                    return positions[cuts[place[term]] : cuts[place[term] + 1]]

                found: dict[int, list] = {}
                near: dict[int, set] = {}
                for w in np.flatnonzero((there[known.terms] | (known.terms < 0)).all(axis=1)) if there.size else ():
                    n = known.length[w]
                    at = listed(known.terms[w, 0]) - int(known.shifts[w, 0])
                    for term, shift in zip(known.terms[w, 1:n], known.shifts[w, 1:n], strict=True):
                        at = at[_among(listed(term), at + int(shift))]
                        if not at.size:
                            break
                    for doc, start in zip(np.searchsorted(begins, at, "right") - 1, at, strict=True):
                        found.setdefault(int(doc), []).append((int(start - begins[doc]), int(start - begins[doc] + n), known.names[known.item[w]]))
                for i in np.flatnonzero((there[known.rarest] | (known.rarest < 0)).all(axis=1)) if there.size else ():
                    terms = known.rarest[i][known.rarest[i] >= 0]
                    if terms.size:
                        at = listed(terms[0])
                        doc = np.searchsorted(begins, at, "right")
                        for term in terms[1:]:
                            other = listed(term)
                            after = np.searchsorted(other, at)
                            close = np.zeros(at.size, bool)
                            for beside in (np.minimum(after, other.size - 1), np.maximum(after - 1, 0)):
                                close |= (abs(other[beside] - at) <= slop) & (np.searchsorted(begins, other[beside], "right") == doc)
                            at, doc = at[close], doc[close]
                        for d in np.unique(doc):
                            near.setdefault(int(d) - 1, set()).add(known.names[i])
                which = np.arange(n_words.size) if every else np.array(sorted({*found, *near}), np.int64)
                hits = [found.get(int(d), ()) for d in which]
                ranges = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("segment")[row].as_py()] * which.size, pa.string()), pa.array(which, pa.int32()),
                        batch.column("doc_ids")[row].values.take(pa.array(which, pa.int64())), pa.array(n_words[which], pa.int64()),
                        pa.array([[x[0] for x in h] for h in hits], ranges), pa.array([[x[1] for x in h] for h in hits], ranges),
                        pa.array([sorted({x[2] for x in h}) for h in hits], pa.list_(pa.string())),
                        pa.array([sorted(near.get(int(d), ())) for d in which], pa.list_(pa.string())),
                    ],
                    ["segment", "place", "doc_id", "n_words", "starts", "ends", "items", "near"],
                )

    return run


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        hit, items, digests, spans = [], [], [], []
        for starts, ends, names in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted(zip(starts, ends, strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            names = sorted(set(names))
            hit.append(sum(b - a for a, b in merged))
            items.append(len(names))
            digests.append(hashlib.sha256(",".join(names).encode()).hexdigest() if names else nothing)
            spans.append([{"start": a, "end": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digests, pa.string()),
                pa.array([x > 0 for x in hit], pa.bool_()), pa.array([len(set(x)) for x in batch.column("near").to_pylist()], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "spans"],
        )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 20) -> DataFrame:
    """Where windows of test items occur in documents, one row per row of docs(doc_id, text).

    Words are runs of ASCII letters and digits and of any other non-ASCII
    characters, A-Z lower-cased. A window is ``window`` consecutive words of an
    item, or all of a shorter item. n_hit counts the document's words inside any
    occurrence, spans gives them as word ranges, items_sha256 digests the sorted
    item ids; n_near counts the items whose NEAR_TERMS rarest terms stand within
    ``slop`` words of the rarest.

    Null or blank text has no words and no hits; an item without words has no
    window; a null item_id counts under the empty name. Null doc_ids and
    repeated rows are kept as rows of their own, and equal item_ids are one
    item. Other columns are ignored; an empty docs gives no rows, an empty
    benchmark no hits.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    items = written(tests.mapInArrow(_items(window), ITEM), "items")
    bits = np.zeros(1 << 20, np.uint8)
    for row in items.mapInArrow(_filter_bits, "bits binary").toLocalIterator():  # 1 MB at a time
        bits |= np.frombuffer(row.bits, np.uint8)
    index = written(docs.select("doc_id", "text").mapInArrow(_index(context.broadcast(bits), window), SEGMENT), "index")

    n_words = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-n_words // BLOCK_WORDS) or 1
    parts = []
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).orderBy("item_id", "terms").collect()
        if not rows and n_blocks > 1:
            continue
        terms = np.unique(np.concatenate([np.asarray(r.terms, np.int64) for r in rows])) if rows else np.zeros(0, np.int64)
        counts = index.select("terms", "starts").mapInArrow(_counted(context.broadcast(terms)), "term long, n long")
        counts = dict(counts.groupBy("term").agg(F.sum("n")).collect()) if rows else {}
        block = _block(rows, counts, window) if rows else _Block(terms, [], *np.zeros((2, 0), np.int32), *np.zeros((2, 0, window), np.int32), np.zeros((0, NEAR_TERMS), np.int32))
        parts.append(index.mapInArrow(_matches(context.broadcast(block), window, slop, n_blocks == 1), HITS))
    found = parts[0]
    if n_blocks > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        names = ["starts", "ends", "items", "near"]
        found = found.groupBy("segment", "place").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in names))
        rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d")).select("segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
        empty = {c: F.array().cast("array<long>" if c in names[:2] else "array<string>") for c in names}
        found = rows.join(found, ["segment", "place"], "left").select("segment", "place", "doc_id", "n_words", *(F.coalesce(c, empty[c]).alias(c) for c in names))
    return found.drop("segment", "place").mapInArrow(_finished, RESULT)
