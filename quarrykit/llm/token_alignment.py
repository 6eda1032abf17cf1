"""Two tokenizers over the same texts: where their tokens end together, and how often each pair of ids does.

Pairs are counted outside memory. A task cuts its texts into slices, sorts the
(B id, A id, document) records of a slice, deals them by B id to radix partitions
and puts each part down as a run of zstd blocks. Runs of a partition are merged
by a heap, a bounded number at a time, until one is left; as it is in order of
the B id, the highest count of an id is known when its last pair has passed. The
counts then meet the runs again, and what they say of each document goes back to
its slice as one vector of each partition.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan
from quarrykit.llm.store import scratch, settled, written

#: Partitions by B id; each ends as one run of all pairs with its ids.
RADIX = 32
#: Runs that are merged at once, pairs of a block, and bytes of text of a slice.
FAN, BLOCK, SLICE = 64, 1 << 13, 1 << 22
#: Bytes of runs that meet the counts of their partition in one task.
GROUP = 48 << 20
#: Bits of a place in a slice; ids of either side have 16.
PLACE_BITS = 20

ENCODED = "slice long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, counts array<binary>, records binary"
RUN = "radix int, blocks array<binary>"
SHARE = "slice long, share binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: Characters that every version of Unicode puts into the same class.
_SETTLED = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")


class Side(NamedTuple):
    """A tokenizer, what each id stands for, and its digits with a comma and with the mark that ends a group."""

    encode: object
    pieces: list[bytes]
    lengths: np.ndarray
    digits: list[bytes]


def _side(encode, pieces: list[bytes], mark: str) -> Side:
    if len(pieces) > 1 << 16 or not all(pieces):
        raise ValueError("ids of 16 bits and tokens of a byte or more are needed")
    return Side(encode, pieces, np.array([len(x) for x in pieces], np.int64), [f"{i}{m}".encode() for i in range(len(pieces)) for m in (",", mark)])


@cache
def byte_side(path: str) -> Side:
    """A byte-level BPE of a tokenizers file.

    Ranks are the file's own ids, which follow its merges, so the faster library
    gives the same ids; it takes the texts whose characters both class alike.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
    ids = {bytes(byte_of[c] for c in word): i for word, i in model["vocab"].items() if all(c in byte_of for c in word)}
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    merges = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
    same = all(model["vocab"].get(x.replace(" ", "")) == 256 + i for i, x in enumerate(merges))
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={}) if same else None

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if fast is None or _SETTLED.search(text):
                out.append(np.array(slow.encode(text, add_special_tokens=False).ids, np.int64))
            else:
                out.append(fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64))
        return out

    table = [b"?"] * (max(max(ids.values()), max(slow.get_added_tokens_decoder(), default=0)) + 1)
    for word, i in ids.items():
        table[i] = word
    return _side(encode, table, "|")


@cache
def piece_side(path: str) -> Side:
    """A sentencepiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return _side(lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)], table, ";")


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in the fewest bytes, under zstd."""
    import zstandard

    small = [a.astype(np.min_scalar_type(int(a.max()) if a.size else 0)) for a in arrays]
    head = struct.pack(f"<B{'cQ' * len(small)}", len(small), *(x for a in small for x in (a.dtype.char.encode(), a.size)))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in small))


def _got(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 1 + struct.calcsize("<cQ") * raw[0], []
    for kind, n in struct.iter_unpack("<cQ", raw[1:at]):
        out.append(np.frombuffer(raw, np.dtype(kind.decode()), n, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind.decode()).itemsize
    return out


def _blocks(keys: np.ndarray, *values: np.ndarray) -> list[bytes]:
    """Rows by ascending key in blocks; keys are put down as steps."""
    return [_put(np.diff(keys[i : i + BLOCK], prepend=0), *(v[i : i + BLOCK] for v in values)) for i in range(0, keys.size, BLOCK)]


def _unblocked(block: bytes) -> list[np.ndarray]:
    steps, *values = _got(block)
    return [np.cumsum(steps), *values]


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) by ascending key of runs of blocks, each key once; of each run one block is open.

    The heap holds the last key of each open block. All rows up to the least of
    these are known: they are summed and put out, and the block that ended is
    followed by the next of its run.
    """
    rest = [iter(r) for r in runs]
    open_: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def following(i: int) -> None:
        block = next(rest[i], None)
        if block is not None:
            open_[i] = _unblocked(block)
            heapq.heappush(heap, (int(open_[i][0][-1]), i))

    for i in range(len(runs)):
        following(i)
    while heap:
        most, _ = heap[0]
        parts = []
        for i, (keys, counts) in open_.items():
            n = int(np.searchsorted(keys, most, "right"))
            if n:
                parts.append((keys[:n], counts[:n]))
                open_[i] = [keys[n:], counts[n:]]
        while heap and heap[0][0] <= most:
            following(heapq.heappop(heap)[1])
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[first], np.add.reduceat(np.concatenate([c for _, c in parts])[order], first)


def _merge(table: pa.Table) -> pa.Table:
    blocks = [b for keys, counts in merged(table.column("blocks").to_pylist()) for b in _blocks(keys, counts)]
    return pa.table({"radix": pa.array([table.column("radix")[0].as_py()], pa.int32()), "blocks": pa.array([blocks], pa.list_(pa.binary()))})


def _best(table: pa.Table) -> pa.Table:
    """As _merge, and whether a pair has the highest count of its B id. Of pairs only those of the last B id wait."""
    out: list[bytes] = []
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def put(n: int) -> None:
        first = np.flatnonzero(np.diff(keys[:n] >> 16, prepend=-1))
        if n:
            most = np.repeat(np.maximum.reduceat(counts[:n], first), np.diff(np.append(first, n)))
            out.extend(_blocks(keys[:n], counts[:n], (counts[:n] == most).astype(np.int64)))

    for more, n in merged(table.column("blocks").to_pylist()):
        keys, counts = np.concatenate([keys, more]), np.concatenate([counts, n])
        whole = int(np.searchsorted(keys >> 16, keys[-1] >> 16))
        if whole >= BLOCK:
            put(whole)
            keys, counts = keys[whole:], counts[whole:]
    put(keys.size)
    return pa.table({"radix": pa.array([table.column("radix")[0].as_py()], pa.int32()), "blocks": pa.array([out], pa.list_(pa.binary()))})


def _document(a: np.ndarray, b: np.ndarray, left: Side, right: Side, digits: list[bytes]) -> tuple[np.ndarray, np.ndarray, str]:
    """The linked ids of either side, and the digest of the groups."""
    end_a, end_b = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])
    cut_a, cut_b = (x[np.minimum(np.searchsorted(x, y), x.size - 1)] == y for x, y in ((end_b, end_a), (end_a, end_b)))
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    line = np.empty(a.size + b.size, np.int64)
    before_b, upto_a = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, "right")
    line[np.arange(a.size) + before_b] = 2 * a + cut_a
    line[np.arange(b.size) + upto_a] = len(left.digits) + 2 * b + cut_b
    return a[cut_a], b[cut_b], hashlib.sha256(b"".join(map(digits.__getitem__, line.tolist()))[:-1]).hexdigest()


def _encoding(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left, right = byte_side(a_path), piece_side(b_path)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in scan.slices(batch, "text", SLICE, (1 << PLACE_BITS) - 1):
                yield _slice(part, number, left, right)
                number += 1

    return run


def _slice(part: pa.RecordBatch, number: int, left: Side, right: Side) -> pa.RecordBatch:
    texts = [t or "" for t in part.column("text").to_pylist()]
    n = len(texts)
    sizes, digests = np.zeros((4, n), np.int64), [""] * n
    linked, digits = [], left.digits + right.digits
    at = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in at]
    for i, text, a, b in zip(at, spaced, left.encode(spaced), right.encode([t[1:] for t in spaced]), strict=True):
        whole = text.encode()
        if b"".join(map(left.pieces.__getitem__, a.tolist())) != whole or b"".join(map(right.pieces.__getitem__, b.tolist())) != whole:
            continue
        link_a, link_b, digests[i] = _document(a, b, left, right, digits)
        sizes[:, i] = a.size, b.size, link_a.size, link_a.size
        linked.append((link_b % RADIX << 32 | link_b << 16 | link_a) << PLACE_BITS | i)
    codes, times = np.unique(np.concatenate(linked) if linked else np.zeros(0, np.int64), return_counts=True)
    pairs = codes >> PLACE_BITS
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    keys, totals = pairs[first], np.add.reduceat(times, first) if first.size else times
    documents = np.diff(np.append(first, codes.size))
    borders = np.searchsorted(keys, np.arange(RADIX + 1) << 32)
    runs = []
    for r, (x, y) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
        if x < y:
            i, j = first[x], first[y] if y < first.size else codes.size
            runs.append((r, _blocks(keys[x:y] & 0xFFFFFFFF, totals[x:y]), _put(documents[x:y], codes[i:j] & (1 << PLACE_BITS) - 1, times[i:j])))
    m = len(runs)
    columns = [pa.array([number] * (n + m), pa.int64()), pa.array([*range(n), *[None] * m], pa.int32()), pa.concat_arrays([part.column("doc_id").cast(pa.int64()), pa.nulls(m, pa.int64())])]
    columns += [pa.array([*x.tolist(), *[None] * m], pa.int64()) for x in sizes] + [pa.array([*digests, *[None] * m], pa.string())]
    columns += [pa.array([*[None] * n, *(r[i] for r in runs)], kind) for i, kind in enumerate((pa.int32(), pa.list_(pa.binary()), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ENCODED.split(", ")])


def _shares(runs: pa.Table, counted: pa.Table) -> pa.Table:
    """What the counts of a partition say of the documents of each slice."""
    known = [np.concatenate(x) for x in zip(*(_unblocked(b) for b in counted.column("blocks")[0].as_py()), strict=True)] if runs.num_rows else []
    slices, shares = [], []
    for row in runs.select(["slice", "counts", "records"]).to_pylist():
        keys = np.concatenate([_unblocked(b)[0] for b in row["counts"]])
        documents, place, times = _got(row["records"])
        at = np.searchsorted(known[0], keys)
        count, best = (np.repeat(x[at], documents) for x in known[1:])
        out = np.zeros((2, int(place.max()) + 1), np.int64)
        np.add.at(out[0], place, times * best)
        np.add.at(out[1], place, times * count)
        slices.append(row["slice"])
        shares.append(_put(*out))
    return pa.table({"slice": pa.array(slices, pa.int64()), "share": pa.array(shares, pa.binary())})


def _summed(documents: pa.Table, shares: pa.Table) -> pa.Table:
    documents = documents.sort_by("place")
    out = np.zeros((2, documents.num_rows), np.int64)
    for share in shares.column("share").to_pylist():
        for own, more in zip(out, _got(share), strict=True):
            own[: more.size] += more
    return documents.drop_columns(["slice", "place"]).append_column("n_best", pa.array(out[0])).append_column("count_sum", pa.array(out[1])).select([f.split()[0] for f in RESULT.split(", ")])


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each row of docs(doc_id, text): its tokens on either side, groups and links, and how they stand in the whole corpus.

    ``a`` is the path of a byte-level BPE, ``b`` of a sentencepiece model that adds
    a space before a text; A encodes space + text. Where a token of A and one of
    B end at the same byte, a group ends, and the two are linked. Null and
    empty texts, and such whose tokens don't give space + text again, have no
    tokens: zeros, and '' for the digest. Texts of any length are taken whole;
    repeated rows and null ids are rows of their own. Other columns don't matter.
    """
    with scratch():
        encoded = written(docs.select("doc_id", "text").mapInArrow(_encoding(a, b), ENCODED), "encoded")
        documents, runs = encoded.where("place IS NOT NULL"), encoded.where("radix IS NOT NULL")
        level = runs.select("radix", F.col("counts").alias("blocks"), F.xxhash64("slice").alias("by"))
        n = documents.select("slice").distinct().count()
        while n > FAN:
            n = -(-n // FAN)
            level = level.withColumn("part", F.pmod("by", F.lit(n)))
            level = written(level.groupBy("radix", "part").applyInArrow(_merge, RUN).withColumn("by", F.xxhash64(F.md5(F.element_at("blocks", 1)))), "merged")
        counted = written(level.groupBy("radix").applyInArrow(_best, RUN), "counted")
        sizes = runs.groupBy("radix").agg(F.ceil(F.sum(F.length("records")) / GROUP).alias("parts"))
        sizes = F.broadcast(written(sizes, "sizes"))  # a row for each partition
        dealt = runs.join(sizes, "radix").select("radix", F.pmod(F.xxhash64("slice"), "parts").cast("int").alias("part"), "slice", "counts", "records")
        copies = counted.join(sizes, "radix").select("radix", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), "blocks")
        shares = written(dealt.groupBy("radix", "part").cogroup(copies.groupBy("radix", "part")).applyInArrow(_shares, SHARE), "shares")
        own = documents.select("slice", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        return settled(own.groupBy("slice").cogroup(shares.groupBy("slice")).applyInArrow(_summed, RESULT))
