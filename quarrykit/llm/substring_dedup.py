"""Substring dedup by hashing the sentences of lines.

A unit is a sentence, normalised; a line break ends one too. Digests of all units
are grouped globally; a unit is repeated if its digest has an earlier ranked
occurrence. Runs of neighbouring repeated units with enough words are removed,
so that a long passage goes wherever its sentences are short, and a short line
that many texts share stays. Offsets are of the original text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan
from quarrykit.llm.store import written

#: Words that a run of repeated units needs to be removed.
LEAST = 25

# The first mark with white space or the line's end behind it ends a sentence. One mark is looked at a time, so that a line of nothing but marks takes linear time.
_SENTENCE = re.compile(r"[^\n]*?[.!?](?=\s|$)|[^\n]+", re.MULTILINE)

UNITS = "doc_id long, key long, seq int, digest long"


def units_of(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, normalised words) of all units in order, in code points."""
    for m in _SENTENCE.finditer(text):
        words = m.group().lower().split()
        if words:
            yield m.end() - len(m.group().lstrip()), m.end(), words


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in scan.slices(batch, "text", most_bytes=2 << 20, most_rows=500):
            ids, keys, places, digests = [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if doc_id is None or not text:
                    continue
                key = zlib.crc32(_bytes(text))
                for seq, (_, _, words) in enumerate(units_of(text)):
                    ids.append(doc_id), keys.append(key), places.append(seq)
                    digests.append(int.from_bytes(hashlib.blake2b(_bytes(" ".join(words)), digest_size=8).digest(), "little", signed=True))
            columns = [pa.array(x, kind) for x, kind in zip((ids, keys, places, digests), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "seq", "digest"])


def repeated_units(docs: DataFrame) -> DataFrame:
    """(doc_id, key, seqs) of the documents with units that occur earlier: key is the CRC-32 of the text, seqs the numbers of the units.

    Occurrences are ranked by (doc_id, key, number). Null or blank text and null
    doc_ids have no units. Rows with the same doc_id and text are one document;
    texts of one doc_id that differ are apart. Other columns of docs are ignored;
    an empty table gives no rows.
    """
    units = written(docs.select("doc_id", "text").mapInArrow(_units, UNITS), "units")
    place = F.struct("doc_id", "key", "seq")
    first = units.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("other")).where("first != other").drop("other")
    first = written(first, "first")  # so that the join can be split where a digest is hot
    later = units.join(first, "digest").where(place != F.col("first"))
    return later.groupBy("doc_id", "key").agg(F.collect_set("seq").alias("seqs"))


def spans_of(text: str, repeated: set[int]) -> list[tuple[int, int]]:
    """The runs of repeated units with LEAST words or more, each from its first unit's start to its last one's end."""
    out, begin, end, n = [], 0, 0, 0
    for seq, (a, b, words) in enumerate([*units_of(text), (0, 0, [])]):
        if seq in repeated:
            begin, end, n = (begin if n else a), b, n + len(words)
        else:
            if n >= LEAST:
                out.append((begin, end))
            n = 0
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed = [], []
        for text, seqs in zip(batch.column("text").to_pylist(), batch.column("__seqs").to_pylist(), strict=True):
            at, out, gone = 0, [], spans_of(text, set(seqs)) if seqs else []
            for a, b in gone:
                out.append(text[at:a])
                at = b
            texts.append(text if not gone else "".join([*out, text[at:]]))
            removed.append([{"start": a, "end": b} for a, b in gone])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, kind)], ["doc_id", "text", "removed"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed) for every row of docs(doc_id, text): the text left, and the spans of the original text that went.

    What counts as repeated, and nulls and ties, are those of repeated_units();
    a run of such units goes from LEAST words on. Rows without such runs keep
    their text, also a null, and have an empty list.
    """
    seqs = repeated_units(docs).select(F.col("doc_id").alias("__doc_id"), F.col("key").alias("__key"), F.col("seqs").alias("__seqs"))
    key = F.crc32(F.col("text").cast("binary"))
    joined = docs.select("doc_id", "text").join(seqs, (F.col("doc_id") == F.col("__doc_id")) & (key == F.col("__key")), "left")
    return joined.select("doc_id", "text", "__seqs").mapInArrow(_cut, "doc_id long, text string, removed array<struct<start:long,end:long>>")
