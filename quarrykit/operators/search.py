"""Keyword, full-text, TF-IDF and vector search, and the context made of hits."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.functions.columns import occurrences
from quarrykit.operators.best import apart, in_small_batches
from quarrykit.operators.dedupe import rejoined
from quarrykit.plans.tables import discard, written

#: Bytes of text whose terms a task sums.
SHARE = 32_000_000
#: Terms that are as frequent as the last one of a vocabulary, of which tasks look for the spelling; beyond it for that of all terms.
TIES = 1_000_000


def keyword_top(df: DataFrame, name: str, text: str, query: str, k: int) -> DataFrame:
    """The k rows that hold the query most often."""
    scored = df.select(name, occurrences(F.col(text), query).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), name).limit(k)


def postings(df: DataFrame, name: str, text: str) -> DataFrame:
    """(term, name, position) of the terms of two or more letters and digits."""
    terms = df.select(name, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("position", "term"))
    return terms.select("term", name, "position")


def match_all(index: DataFrame, name: str, terms: Sequence[str]) -> DataFrame:
    """The rows that hold all terms."""
    found = index.where(F.col("term").isin(list(terms))).groupBy(name).agg(F.count_distinct("term").alias("n"))
    return found.where(F.col("n") == len(set(terms))).select(name)


def match_phrase(index: DataFrame, name: str, terms: Sequence[str]) -> DataFrame:
    """(name, hits): the rows that hold the terms one after another."""
    starts = None
    for i, term in enumerate(terms):
        here = index.where(F.col("term") == term).select(name, (F.col("position") - i).alias("start"))
        starts = here if starts is None else starts.join(here, [name, "start"])
    return starts.groupBy(name).agg(F.count("*").alias("hits"))


def match_prefix_not(index: DataFrame, name: str, prefix: str, without: str) -> DataFrame:
    """The rows that hold a term with the prefix, and not another term."""
    return index.where(F.col("term").startswith(prefix)).select(name).distinct().join(index.where(F.col("term") == without).select(name).distinct(), name, "left_anti")


@in_small_batches
def tfidf_vectors(df: DataFrame, name: str, text: str, vocabulary: int = 200_000) -> DataFrame:
    """(name, terms, weights), written: tf * (ln((1 + n) / (1 + df)) + 1), each row of length one, its terms by number.

    Terms are words and pairs of neighbouring words; the vocabulary, the most
    frequent of them, has a size of its own, which bounds what is broadcast: a hash
    of 64 bits for each. Rows of one name are one; a row without a term of the
    vocabulary is left out. Terms are int32 and weights float64, each row's together
    in one binary value.
    """
    spark = df.sparkSession
    lowered = F.lower(F.coalesce(text, F.lit("")))
    texts = df.select(lowered.alias("text"))
    names = df.groupBy(name).agg(F.count("*").alias("rows"), F.sum(F.octet_length(text)).alias("bytes"))
    names = names.agg(F.sum("rows").alias("n"), F.max("rows").alias("most"), F.sum("bytes").alias("bytes")).first()
    shares = texts.mapInArrow(_term_totals((names.bytes or 0) // SHARE + 1), "share int, hashes binary, counts binary")
    totals = written(shares.groupBy("share").applyInArrow(_summed(2), "hash long, n long"), "totals")
    if totals.count() <= vocabulary:  # terms that stand once belong to it
        discard(totals)
        totals = written(shares.groupBy("share").applyInArrow(_summed(1), "hash long, n long"), "totals")
    kept = _most_frequent(texts, totals, vocabulary)
    discard(totals)
    del shares, totals
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # what was shuffled for the totals leaves the disks
    known = spark.sparkContext.broadcast(_ordered(kept))
    kind = dict(df.dtypes)[name]
    rows = df.select(name, F.array(lowered).alias("texts")) if (names.most or 0) < 2 else df.groupBy(name).agg(F.collect_list(lowered).alias("texts"))
    counts = written(rows.mapInArrow(_term_counts(known, name), f"{name} {kind}, terms binary, counts binary"), "counts")
    found = counts.select("terms").mapInArrow(_rows_of_terms(len(kept)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # as many rows as the vocabulary
    idf = np.zeros(vocabulary)
    idf[found.column("term").to_numpy()] = np.log((1 + (names.n or 0)) / (1 + found.column("df").to_numpy())) + 1
    weighed = counts.mapInArrow(_weights(spark.sparkContext.broadcast(idf), name), f"{name} {kind}, terms binary, weights binary")
    vectors = written(weighed, "vectors")
    discard(counts)
    return vectors


def _words(texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of the words ``[a-z0-9]{2,}`` of all texts: bytes, starts and ends, their hashes, their texts, and those that have another one after them in their text."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _INSIDE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = at[(at > 0) & (at < buf.size)]
    first[borders], last[borders - 1] = inside[borders], inside[borders - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start > 1
    start, end = start[long], end[long]
    hashes, x = np.zeros(len(start), np.uint64), 0
    while x < len(start):  # sums of what the bytes before a place weigh, for as many words at a time as the tables hold
        y = max(x + 1, int(np.searchsorted(end, start[x] + _PIECE, "right")))
        piece = _BYTES[buf[start[x] : end[y - 1]]]
        power, back = _powers(max(piece.size, _PIECE))
        sums = np.zeros(piece.size + 1, np.uint64)
        np.cumsum(piece * power[: piece.size], out=sums[1:])
        begins = start[x:y] - start[x]
        hashes[x:y] = _mixed((sums[end[x:y] - start[x]] - sums[begins]) * back[begins])
        x = y
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, at)))
    return (buf, start, end), hashes, row, np.flatnonzero(row[1:] == row[:-1])


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    lengths = end - start
    ends = np.cumsum(lengths)
    data = buf[np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(start - ends + lengths, lengths)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data))


#: Bytes that are hashed at a time, unless one word has more.
_PIECE = 1 << 16


@lru_cache(2)
def _powers(n: int) -> list[np.ndarray]:
    """The powers of a base and of its inverse among 64-bit numbers."""
    return [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64))]


_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = True
_BYTES = np.random.Generator(np.random.PCG64(20240613)).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _paired(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _mixed(hashes[first] * np.uint64(0x2545F4914F6CDD1D) + hashes[first + 1])


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Borders of texts that have so many bytes together, or of one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _most_frequent(texts: DataFrame, totals: DataFrame, vocabulary: int) -> np.ndarray:
    """The hashes of the most frequent terms; of those as frequent as the last one the least in the order of strings."""
    top = totals.orderBy(F.desc("n"), "hash").limit(vocabulary + 1).toArrow()
    hashes, n = top.column("hash").to_numpy(), top.column("n").to_numpy()
    if n.size <= vocabulary:
        return hashes.view(np.uint64)
    if n[vocabulary - 1] == n[vocabulary]:
        sure = hashes[n > n[vocabulary]]
        ties = totals.where(F.col("n") == int(n[vocabulary])).select("hash")
        sent = None
        if ties.count() <= TIES:
            sent = texts.sparkSession.sparkContext.broadcast(_ordered(ties.toArrow().column(0).to_numpy().view(np.uint64)))
        spelled = texts.mapInArrow(_spelled(sent), "hash long, term string").distinct().join(ties, "hash", "left_semi")
        rest = spelled.orderBy("term").limit(vocabulary - sure.size).select("hash").toArrow().column(0).to_numpy()
        return np.concatenate([sure, rest]).view(np.uint64)
    return hashes[:vocabulary].view(np.uint64)


def _sorted_once(hashes: np.ndarray) -> np.ndarray:
    """The place of each of the hashes; one whose upper bits another one has may come in parts."""
    bits = np.uint64(max(len(hashes), 1).bit_length())
    places = np.sort(hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))
    hashes = hashes[places.astype(np.int64)]
    return places[np.concatenate([[True], hashes[1:] != hashes[:-1]])].astype(np.int64) if hashes.size else np.zeros(0, np.int64)


def _term_totals(shares: int):
    """(share, hashes, counts): a slice's terms, each once, by equal ranges of their hashes."""
    borders = np.array([(i << 64) // shares for i in range(1, shares)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _slices(batch.column(0), 8_000_000):
                _, hashes, _, first = _words(batch.column(0).slice(at, to - at))
                every = np.sort(np.concatenate([hashes, _paired(hashes, first)]))
                edges = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if every.size else np.zeros(0, np.int64)
                counts, every = np.diff(np.append(edges, every.size)).astype(np.int32), every[edges]
                sizes = np.diff(np.concatenate([[0], np.searchsorted(every, borders), [every.size]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(shares, dtype=np.int32)), _together(every, sizes), _together(counts, sizes)], ["share", "hashes", "counts"])

    return run


def _summed(least: int):
    """(hash, n) of a share's terms that stand so often."""

    def run(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([apart(c, np.uint64)[1] for c in table.column("hashes").chunks])
        counts = np.concatenate([apart(c, np.int32)[1] for c in table.column("counts").chunks])
        order = np.argsort(hashes)
        hashes = hashes[order]
        edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if hashes.size else np.zeros(0, np.int64)
        n = np.add.reduceat(counts[order].astype(np.int64), edges) if edges.size else np.zeros(0, np.int64)
        return pa.table({"hash": hashes[edges][n >= least].view(np.int64), "n": n[n >= least]})

    return run


def _spelled(sent):
    """(hash, term) of the terms whose hashes are sent, or of all, once for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _slices(batch.column(0), 8_000_000):
                (buf, start, end), hashes, _, first = _words(batch.column(0).slice(at, to - at))
                for every, begins, pair in ((hashes, np.arange(len(hashes)), False), (_paired(hashes, first), first, True)):
                    if sent is not None:
                        held = sent.value[0].take(_places(every, sent.value[0], sent.value[2])) == every
                        every, begins = every[held], begins[held]
                    once = _sorted_once(every)
                    begins = begins[once]
                    terms = _strings(buf, start[begins], end[begins])
                    if pair:
                        terms = pc.binary_join_element_wise(terms, _strings(buf, start[begins + 1], end[begins + 1]), " ")
                    yield pa.RecordBatch.from_arrays([pa.array(every[once].view(np.int64)), terms], ["hash", "term"])

    return run


#: Bits of a hash that lead to its place among those of the vocabulary.
_LEADING = 20


def _ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, ascending, with a greatest number; which they are; the places from which those of the same leading bits stand."""
    order = np.argsort(hashes)
    found = np.append(hashes[order], np.uint64(2**64 - 1))
    return found, order, np.searchsorted(found[:-1], np.arange(2**_LEADING, dtype=np.uint64) << np.uint64(64 - _LEADING)).astype(np.int32)


def _places(h: np.ndarray, hashed: np.ndarray, leading: np.ndarray) -> np.ndarray:
    """The places of hashes among those that ascend, or of a greater one."""
    place = leading.take((h >> np.uint64(64 - _LEADING)).astype(np.int64))
    rest = np.flatnonzero(hashed.take(place) < h)
    while rest.size:
        place[rest] += 1
        rest = rest[hashed.take(place[rest]) < h[rest]]
    return place


def _together(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each row's values in one binary value."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            yield batch.slice(at, 2000)


def _term_counts(known, name: str):
    """The numbers of a row's terms, ascending, and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, number, leading = known.value
        size = max(len(number), 1)
        for batch in _parts(batches):
            every = batch.column(1).flatten()
            row_of = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column(1)), np.int64))
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, to in _slices(every, 1_000_000):
                _, hashes, text, first = _words(every.slice(at, to - at))
                found = []
                for h, row in ((hashes, row_of[at + text]), (_paired(hashes, first), row_of[at + text[first]])):
                    place = _places(h, hashed, leading)
                    held = hashed.take(place) == h
                    found.append(row[held] * size + number[place[held]])
                key, count = np.unique(np.concatenate(found), return_counts=True)
                keys.append(key)
                counts.append(count)
            key, count = np.concatenate(keys), np.concatenate(counts)
            if (key[1:] <= key[:-1]).any():  # the texts of one name lie in several slices
                key, where = np.unique(key, return_inverse=True)
                count = np.bincount(where, count).astype(np.int64)
            sizes = np.diff(np.searchsorted(key, np.arange(batch.num_rows + 1) * size))
            out = pa.RecordBatch.from_arrays([batch.column(0), _together((key % size).astype(np.int32), sizes), _together(count.astype(np.int32), sizes)], [name, "terms", "counts"])
            yield out.filter(pa.array(sizes > 0))

    return run


def _rows_of_terms(size: int):
    """(term, df) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(apart(batch.column(0), np.int32)[1], minlength=size)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(total[term])], ["term", "df"])

    return run


def _weights(idf, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = idf.value
        for batch in _parts(batches):
            sizes, terms = apart(batch.column(1), np.int32)
            w = apart(batch.column(2), np.int32)[1] * known[terms]
            row = np.repeat(np.arange(batch.num_rows), sizes)
            w = w / np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _together(w, sizes)], [name, "terms", "weights"])

    return run


def fused(words: DataFrame, near: DataFrame, name: str) -> DataFrame:
    """(name, src, pos): the hits of two searches (name, pos) in one list, each once: those of the first (src 0) before those of the second."""
    both = words.select(name, F.lit(0).alias("src"), "pos").unionByName(near.select(name, F.lit(1).alias("src"), "pos"))
    return both.groupBy(name).agg(F.min(F.struct("src", "pos")).alias("r")).select(name, "r.*")


def within_budget(parts: DataFrame, order: Sequence[str], length: str, budget: int) -> DataFrame:
    """Parts in order until their joined length passes the budget, the crossing one included.

    Lengths are summed inside ranges of the order and moved by the sums of the
    ranges before, so no task sees all rows.
    """
    spread = parts.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = written(spread.withColumn("__inside", F.coalesce(F.sum(F.col(length) + 1).over(w), F.lit(0))), "lengths")
    sums = inside.groupBy("__part").agg(F.coalesce(F.sum(F.col(length) + 1), F.lit(0)).alias("__sum"))
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    placed = inside.join(F.broadcast(offsets), "__part")
    return placed.where(F.col("__offset") + F.col("__inside") - 1 <= budget).select(*parts.columns)


def masked_softmax(df: DataFrame, group: str, score: str, mask: str) -> DataFrame:
    """Softmax of a group's scores where the mask holds, else 0; null where a group is wholly masked. A null group is one."""
    s = F.when(F.col(mask), F.col(score))
    with_top = rejoined(df, df.groupBy(group).agg(F.max(s).alias("__top")), [group])
    e = F.when(F.col(mask), F.exp(F.col(score) - F.col("__top")))
    total = with_top.groupBy(group).agg(F.sum(e).alias("__sum"))
    return rejoined(with_top, total, [group]).withColumn("weight", F.when(F.col("__sum").isNotNull(), F.coalesce(e, F.lit(0.0)) / F.col("__sum"))).drop("__top", "__sum")
