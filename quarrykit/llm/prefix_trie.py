"""The prefix trie of conversations, its subtrees summed over an Euler tour.

A node is a sequence of first turns; it is known by the XOR of the hashes of
(turn, depth) along it, 128 bits, so a conversation's nodes are running XORs
over its turns. Nodes are numbered by their least member and depth, which puts
most of a tour in neighbouring places. Each has an enter and an exit arc. The
tour is ranked as a linked list: chains inside a bucket of bounded size become
one link, then the links of larger buckets, and so on; where that no longer
helps, pointers are doubled. What lies below a node is the difference of the
suffix sums at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.llm.store import scratch, settled, written
from quarrykit.operators.dedupe import numbered, ranked

#: Links that one task ranks at most.
BUCKET = 1 << 20
#: Bytes of a piece of a node's list of ids.
PIECE = 1 << 20
#: Turns that a conversation may take over from another one, and how many conversations share a head.
HEAD, SHARED = 8, 5


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, item, bytes): the turns of each conversation in order, from 1 on, with a digest of role and text instead of them.

    Order is by turn, null first; equal turns of a conversation stand by role,
    then by text. A null role or text is empty. Rows without a conv_id belong to no
    conversation and go. Other columns don't matter.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    item = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    # Texts only move where some turn is there twice.
    tied = not own.groupBy("conv_id", "turn").count().where("count > 1").isEmpty()
    small = own.select("conv_id", "turn", *(["role", "text"] if tied else []), item.alias("item"), F.octet_length("text").cast("long").alias("bytes"))
    return ranked(small, ["conv_id"], ["turn", *(["role", "text"] if tied else [])], "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "item", "bytes")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conv_ids where each conversation c has the first h turns of conversation c - c % 5 in place of its own first h; h is crc32(c) % 9.

    % takes the sign of c. A base with fewer turns gives what it has, a missing
    one nothing.
    """
    lengths = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    c = F.col("conv_id")
    info = lengths.select("conv_id", (c - c % SHARED).alias("base"), (F.crc32(c.cast("string").cast("binary")) % (HEAD + 1)).alias("h"))
    info = info.join(lengths.select(F.col("conv_id").alias("base"), "n"), "base", "left")
    info = written(info.select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("k")), "heads")
    own = turns.join(info, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "item", "bytes")
    others = F.sequence(F.when(c > 0, 0).otherwise(1 - SHARED), F.when(c < 0, 0).otherwise(SHARED - 1))
    lent = turns.where((F.col("pos") <= HEAD) & (c % SHARED == 0)).select(F.explode(others).alias("d"), (c + F.col("d")).alias("to"), c.alias("from"), "pos", "item", "bytes")
    lent = lent.join(info, (lent["to"] == info["conv_id"]) & (lent["from"] == info["base"])).where("pos <= h").select("conv_id", "pos", "item", "bytes")
    return own.unionByName(lent), info.select("conv_id")


def _running(df: DataFrame, key: str, order: str, names: Sequence[str]) -> DataFrame:
    """df with each of names(long) as its XOR over the rows of the key up to this one; a key with a great many rows is spread over tasks."""
    spread = df.repartitionByRange(key, order).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part", key).orderBy(order)
    inside = written(spread.withColumns({n: F.bit_xor(n).over(w) for n in names}), "running")
    last = inside.groupBy(key, "part").agg(F.max_by(F.struct(*names), order).alias("r")).select(key, "part", "r.*")
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A part has one key at most that began before it.
    carry = last.select(key, "part", *(F.bit_xor(n).over(before).alias(f"{n}_before") for n in names)).where(f"{names[0]}_before IS NOT NULL")
    out = inside.join(F.broadcast(carry), [key, "part"], "left")
    return out.select(*(F.col(n).bitwiseXOR(F.coalesce(f"{n}_before", F.lit(0))).alias(n) if n in names else F.col(n) for n in df.columns))


def _chains(ids: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links by ascending id: the place of the next one (own length: not here), of the last one of the chain, and which are first."""
    n = ids.size
    at = np.minimum(np.searchsorted(ids, following), n - 1)
    here = np.where(ids[at] == following, at, n)
    first = np.ones(n + 1, bool)
    first[here] = False
    jump, last = np.append(here, n), np.arange(n + 1)
    while (live := jump != n).any():
        last[live] = last[jump[live]]
        jump = jump[jump]
    return here, last[:n], first[:n]


def _suffixes(here: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of weights (n, k) from each link to the end of its chain."""
    n = here.size
    jump, total = np.append(here, n), np.vstack([weights, np.zeros((1, weights.shape[1]), np.int64)])
    while (jump != n).any():
        total = total + total[jump]
        jump = jump[jump]
    return total[:n]


def _arrays(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    weights = np.stack([table.column(n).to_numpy()[order] for n in names], 1)
    return ids[order], table.column("next").fill_null(-1).to_numpy()[order], weights


def _columns(ids: np.ndarray, following: np.ndarray | None, weights: np.ndarray, names: Sequence[str]) -> pa.Table:
    columns = {"id": pa.array(ids)} | ({} if following is None else {"next": pa.array(following, mask=following < 0)})
    return pa.table(columns | {n: pa.array(weights[:, i]) for i, n in enumerate(names)})


def _contracted(names: Sequence[str]):
    """The first link of each chain of a bucket, with the chain's sums and what follows it elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        ids, following, weights = _arrays(table, names)
        here, last, first = _chains(ids, following)
        out = _columns(ids[first], following[last][first], _suffixes(here, weights)[first], names)
        return out.append_column("place", table.column("bucket").combine_chunks()[: len(out)])

    return run


def _expanded(names: Sequence[str]):
    """The suffix sums of all links of a bucket from those of the first ones of its chains."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        ids, following, weights = _arrays(table, names)
        here, last, first = _chains(ids, following)
        inside = _suffixes(here, weights)
        known = known.combine_chunks()
        order = np.argsort(known.column("id").to_numpy())
        sums = np.stack([known.column(n).to_numpy()[order] for n in names], 1)
        if not np.array_equal(ids[first], known.column("id").to_numpy()[order]):
            raise ValueError("links are no list: a chain has no sums")
        beyond = np.zeros((ids.size, len(names)), np.int64)
        beyond[last[first]] = sums - inside[first]
        return _columns(ids, None, inside + beyond[last], names)

    return run


def _doubled(links: DataFrame, names: Sequence[str]) -> DataFrame:
    """Suffix sums by doubling pointers: as many rounds as the length has binary digits."""
    now = written(links, "links")
    while not now.where("next IS NOT NULL").isEmpty():
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("then"), *(F.col(n).alias(f"{n}_then") for n in names))
        more = now.where("next IS NOT NULL").join(ahead, "next").select("id", F.col("then").alias("next"), *((F.col(n) + F.col(f"{n}_then")).alias(n) for n in names))
        now = written(now.where("next IS NULL").unionByName(more), "links")
    return now.drop("next")


def list_ranks(links: DataFrame, names: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """(id, names): for each link the sums of its weights and of those after it.

    ``links`` has id(long, each once), next(long, null at an end) and weights
    (long). Buckets are ranges of ids with ``bucket`` links about, so lists whose
    neighbours have near ids shrink most.
    """
    kind = "id long, next long, " + ", ".join(f"{n} long" for n in names)
    held = links.select("id", "next", *names)
    levels = []
    n = before = held.count()
    while n > bucket or not levels:
        parts = max(-(-n // bucket), 1 if levels else int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # Written, since ranges are sampled and another run might draw other borders.
        level = written(held.select("id", "next", *names).repartitionByRange(parts, "id").withColumn("bucket", F.spark_partition_id()), "links")
        held = written(level.groupBy("bucket").applyInArrow(_contracted(names), f"{kind}, place int"), "chains")
        levels.append((level, held.select("id", "place")))
        before, n = n, held.count()
        if n > bucket and n > before // 2:
            break
    # What is left has ``bucket`` links at most, unless chains did not meet in buckets.
    held = held.drop("place")
    sums = _doubled(held, names) if n > bucket else held.groupBy().applyInArrow(_all(names), kind).drop("next")
    out = "id long, " + ", ".join(f"{n} long" for n in names)
    for level, firsts in reversed(levels):
        sums = level.groupBy("bucket").cogroup(sums.join(firsts, "id").groupBy("place")).applyInArrow(_expanded(names), out)
    return sums


def _all(names: Sequence[str]):
    def run(table: pa.Table) -> pa.Table:
        ids, following, weights = _arrays(table, names)
        return _columns(ids, following, _suffixes(_chains(ids, following)[0], weights), names)

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, conv_id) in order: the ids of a node, joined, in pieces."""
    for batch in batches:
        a, b, c = (batch.column(i).to_numpy() for i in range(3))
        borders = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))) if a.size else np.zeros(0, np.int64)
        rows = []
        for x, y in zip(borders, np.append(borders[1:], a.size), strict=True):
            for at in range(x, y, PIECE // 20):
                ids = c[at : min(y, at + PIECE // 20)]
                rows.append((int(a[x]), int(b[x]), int(ids[0]), ",".join(map(str, ids.tolist())).encode()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["a", "b", "at", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: the digest of each node's ids; of a node only the state of its digest is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids"), strict=True):
            if node != (a, b):
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        yield _digests(out)
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends"])


def id_digests(members: DataFrame) -> DataFrame:
    """(a, b, ends): the SHA-256 of the conv_ids of each (a, b), ascending and comma-joined.

    Ids are joined to pieces where ranges of the order hold them, so a node with
    a great many sends a piece for each 50 000, and its digest, which can't be
    split, streams over these.
    """
    order = ["a", "b", "conv_id"]
    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "a long, b long, at long, ids binary")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "at").mapInArrow(_hashed, "a long, b long, ends string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A row for each distinct sequence of first turns, the empty one included.

    ``turns`` has (conv_id, pos, item, bytes) with pos from 1 on without gaps, as
    digested() gives; ``conversations`` (conv_id) has each conversation once, also
    one without turns, which is a member of the root alone. Without conversations
    there is no node. Columns: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and enter_at and exit_at, the places of the
    node's arcs in the tour from 0 on: a node is below another one if its places
    are between the other's.
    """
    with scratch():
        start = conversations.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("bytes"))
        hashes = turns.select("conv_id", "pos", F.xxhash64("item", "pos").alias("x"), F.xxhash64(F.lit(7), "pos", "item").alias("y"), "bytes")
        steps = start.unionByName(hashes).withColumns({"a": F.col("x"), "b": F.col("y")})
        paths = _running(steps, "conv_id", "pos", ["a", "b"])
        above = [F.min(F.col("a").bitwiseXOR(F.col("x"))).alias("up_a"), F.min(F.col("b").bitwiseXOR(F.col("y"))).alias("up_b")]
        nodes = written(paths.groupBy("a", "b", F.col("pos").alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), *above), "nodes")
        nodes = written(numbered(nodes, ["conv_id", "depth"], "n", 0), "nodes")

        up = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("n").alias("p"), F.col("conv_id").alias("parent_conv_id"))
        below = written(nodes.where("depth > 0").join(up, ["up_a", "up_b", "depth"]).select("n", "p", "parent_conv_id"), "below")
        siblings = numbered(below.select("n", "p"), ["p", "n"], "m")
        siblings = written(siblings, "siblings")
        after = siblings.select("p", (F.col("m") - 1).alias("m"), F.col("n").alias("sibling"))
        siblings = siblings.join(after, ["p", "m"], "left").select("n", "sibling")
        children = below.groupBy("p").agg(F.min("n").alias("child"), F.count("*").alias("n_children")).withColumnRenamed("p", "n")
        known = nodes.select("n", "a", "b", "conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
        known = known.join(below, "n", "left").join(siblings, "n", "left").join(children, "n", "left").fillna(0, ["n_children"])
        known = written(known, "known")

        enter = known.select((2 * F.col("n")).alias("id"), F.coalesce(2 * F.col("child"), 2 * F.col("n") + 1).alias("next"), F.lit(1).cast("long").alias("steps"), (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
        leave = known.select((2 * F.col("n") + 1).alias("id"), F.coalesce(2 * F.col("sibling"), 2 * F.col("p") + 1).alias("next"), F.lit(1).cast("long").alias("steps"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        sums = list_ranks(enter.unionByName(leave), ["steps", "leaves", "saved"], bucket)
        side = lambda x: F.max(F.when(F.col("id") % 2 == x, F.struct("steps", "leaves", "saved")))
        both = sums.groupBy(F.shiftright("id", 1).alias("n")).agg(side(0).alias("i"), side(1).alias("o"))

        ends = paths.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "pos").alias("e")).select("conv_id", "e.*")
        out = known.join(both, "n").join(id_digests(ends), ["a", "b"], "left").withColumn("arcs", 2 * F.lit(nodes.count()))
        return settled(
            out.select(
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("i.leaves") - F.col("o.leaves")).alias("n_leaves"), (F.col("i.saved") - F.col("o.saved")).alias("saved_tokens"),
                F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"), (F.col("arcs") - F.col("i.steps")).alias("enter_at"), (F.col("arcs") - F.col("o.steps")).alias("exit_at"),
            )
        )
