"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: rare before frequent. It is cut at fixed
borders into fragments, and every set with it, so that a fragment of a set holds
its n-grams of one range of the order. Equal sets are one node. Two sets that
overlap enough share an n-gram among the first few of each (the prefix), so
pairs are sought among the prefixes only. The overlap of a pair is counted for
each fragment by itself, one row per pair and fragment, and summed per pair.
Pairs inside a component that is already connected can't change the result and
are never made.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan
from quarrykit.llm.bits import filter_of, passed
from quarrykit.llm.components import connected_components
from quarrykit.llm.store import discard, settled, written

#: Cells of each frequency sketch. Their number sets how finely n-grams are ordered, never what is found.
CELLS = 1 << 18
CHUNK = 1 << 10
FRAGMENTS = 4
#: Turns at most in which the nodes of a bucket meet one other node only (they end when a turn finds next to nothing); members of a
#: bucket for each node left from which on that is worth while; links that make a node well connected. They set the work, not the result.
HUB_TURNS = 6
FEW = 8
CONNECTED = 3


class Order(NamedTuple):
    """The global order of n-grams: from sketched frequencies of n-grams and of words."""

    gram: np.ndarray
    word: np.ndarray

    def keys(self, words: scan.Words, grams: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
        """Order keys of 63 bits: class of sketched frequency, then expected frequency by the words, then hash."""
        weight = self.word[(words.hash >> np.uint64(46)).astype(np.int64)]
        count = np.diff(words.first)
        begin = np.repeat(words.first[:-1] - first[:-1], np.diff(first)) + np.arange(grams.size)
        length = np.minimum(np.repeat(count, np.diff(first)), k)
        expected = weight[begin].copy()
        for j in range(1, k):
            more = length > j
            expected[more] += weight[begin[more] + j]
        key = self.gram[(grams >> np.uint64(46)).astype(np.int64)].astype(np.uint64) << np.uint64(57)
        key |= np.minimum(expected, 255).astype(np.uint64) << np.uint64(49)
        return (key | (grams >> np.uint64(15))).view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for part in scan.slices(batch, "text"):
                words = scan.words_of(*scan.buffer_of(part.column("text")), scan.SPACED, True)
                grams, _ = scan.shingles_of(words, k)
                total[:CELLS] += np.bincount((grams >> np.uint64(46)).astype(np.int64), minlength=CELLS)
                total[CELLS:] += np.bincount((words.hash >> np.uint64(46)).astype(np.int64), minlength=CELLS)
        parts = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "counts"]
        )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])


def global_order(texts: DataFrame, k: int) -> Order:
    """Sketches of all texts, summed per chunk of cells: their size is fixed, whatever the corpus."""
    schema = "chunk int, counts binary"
    rows = texts.mapInArrow(_sketch(k), schema).repartition(32, "chunk").mapInArrow(_summed, schema).collect()
    total = np.zeros(2 * CELLS, np.int64)
    for chunk, counts in rows:
        total[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, np.int64)
    grams, words = total[:CELLS], total[CELLS:]
    noise = grams.mean() + 4 * np.sqrt(grams.mean())
    classes = np.where(grams > noise, 1 + np.log2(np.maximum(1, grams - noise + 1)), 0)
    weights = np.log2(1 + words / max(1, words.sum()) * 2**24) * 255 / (24 * k)
    return Order(np.minimum(classes, 63).astype(np.uint8), np.rint(weights).astype(np.int32))


def _node(own: np.ndarray) -> int:
    """64 bits for a set of n-grams."""
    return int(scan.mixed(scan.mixed(own).sum(keepdims=True) ^ (own.sum() + np.uint64(own.size))).view(np.int64)[0])


def _profiles(order, k: int, percent: int):
    """Of each document: size and node of its set, the prefix in the global order, and where its own fragments would be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for batch in batches:
            for part in scan.slices(batch, "text"):
                words = scan.words_of(*scan.buffer_of(part.column("text")), scan.SPACED, True)
                grams, first = scan.shingles_of(words, k)
                keys = known.keys(words, grams, first, k)
                sizes, nodes, prefixes, cuts = [], [], [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own, at = np.unique(grams[a:b], return_index=True)
                    sizes.append(own.size)
                    if not own.size:
                        nodes.append(None), prefixes.append(None), cuts.append(None)
                        continue
                    nodes.append(_node(own))
                    ranked = np.sort(keys[a:b][at])
                    prefixes.append(ranked[: own.size * (100 - percent) // 100 + 1])
                    cuts.append(ranked[[own.size * i // FRAGMENTS for i in range(1, FRAGMENTS)]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, cuts))],
                    ["doc_id", "n_shingles", "node", "prefix", "cuts"],
                )

    return run


def _cut(order, wanted, borders: list[int], k: int):
    """(node, fragment, grams) of each document that the filter lets through: its whole set, cut at the borders of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = order.value, wanted.value
        for batch in batches:
            there = np.asarray(batch.column("doc_id").is_valid())
            batch = batch.filter(pa.array(there & passed(bits, batch.column("doc_id").fill_null(0).to_numpy())))
            for part in scan.slices(batch, "text"):
                words = scan.words_of(*scan.buffer_of(part.column("text")), scan.SPACED, True)
                grams, first = scan.shingles_of(words, k)
                fragment = np.searchsorted(borders, known.keys(words, grams, first, k), "right")
                nodes, numbers, pieces = [], [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own, at = np.unique(grams[a:b], return_index=True)
                    for i in range(FRAGMENTS) if own.size else ():
                        piece = scan.signed(own[fragment[a:b][at] == i])
                        nodes.append(_node(own)), numbers.append(i), pieces.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(pieces, pa.list_(pa.int64()))], ["node", "fragment", "grams"]
                )

    return run


def _partials(pairs: DataFrame, sets: DataFrame, which: str) -> DataFrame:
    """pairs with, for each of the fragments that ``which`` selects: part, the overlap there, and what the fragment has of either set."""
    sets = sets.where(which)
    right = sets.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    both = pairs.join(right, "b").join(sets.select(F.col("node").alias("a"), "fragment", "grams"), ["a", "fragment"])
    return both.select(
        *pairs.columns, "fragment", F.size(F.array_intersect("grams", "grams_b")).alias("part"), F.size("grams").alias("sa"), F.size("grams_b").alias("sb")
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), written: the pairs(a, b, na, nb) that are similar enough by the sum of their partial overlaps.

    The first fragment goes ahead: it rules out most pairs that aren't similar,
    so that the others are only moved for the rest.
    """
    enough = f"100L * overlap >= {percent}L * (na + nb - overlap)"
    key = ["a", "b", "na", "nb"]
    most = F.col("part") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb"))
    ahead = _partials(pairs, sets, "fragment = 0").withColumn("overlap", most).where(enough)
    ahead = written(ahead.select(*key, "fragment", "part").distinct(), "ahead")
    parts = _partials(ahead.select(*key), sets, "fragment > 0").select(*key, "fragment", "part").unionByName(ahead)
    # A set can be in the table twice, if a text repeats and the filter lets both through: its parts are equal.
    each = [F.coalesce(F.max(F.when(F.col("fragment") == i, F.col("part"))), F.lit(0)) for i in range(FRAGMENTS)]
    overlap = sum(each[1:], each[0])
    found = written(parts.groupBy(*key).agg(overlap.alias("overlap")).where(enough).select("a", "b"), "links")
    discard(ahead)
    return found


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text).

    A set holds the distinct shingles of k words (words are split at ASCII white
    space, A-Z lower-cased); fewer words are one shingle; no words, an empty set.
    Two documents are linked when 100 * overlap >= percent * union;
    component_id is the least doc_id that links reach.

    Null or blank text: size 0, linked with nothing. Null doc_id: kept, with a
    null component, and linked with nothing. Repeated rows are kept; rows of an
    equal doc_id are one document for the links, whatever their texts. Very long
    texts are hashed in pieces. Other columns of docs are ignored; an empty
    table gives no rows. The rows are computed before this returns.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", "text")
    order = context.broadcast(global_order(texts, k))
    schema = "doc_id long, n_shingles long, node long, prefix array<long>, cuts array<long>"
    profiles = written(texts.mapInArrow(_profiles(order, k, percent), schema), "profiles")
    members = written(profiles.select("doc_id", "n_shingles", "node"), "members")
    known = members.where("node IS NOT NULL AND doc_id IS NOT NULL")
    borders = profiles.agg(*(F.percentile_approx(F.get("cuts", F.lit(i)), 0.5).alias(f"b{i}") for i in range(FRAGMENTS - 1))).first()
    borders = sorted(x or 0 for x in borders)

    # One document of each node, the first, has its postings; grams that a single node has are of no use.
    owners = written(known.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "owners")
    prefixes = profiles.select("doc_id", "node", F.col("n_shingles").cast("int").alias("n"), "prefix")
    prefixes = written(prefixes.join(owners, ["doc_id", "node"], "left_semi"), "prefixes")
    discard(profiles)
    postings = prefixes.select("node", "doc_id", "n", F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last"), F.posexplode("prefix").alias("pos", "gram"))
    several = postings.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("gram")
    met = written(postings.join(several, "gram"), "met")
    discard(prefixes)
    # Of two sets, take the one whose prefix ends first. What the pair shares of its prefix is in the other's prefix too, so most
    # is a bound of what they share in all: the set without the part of its prefix that no other prefix has.
    most = met.groupBy("node").agg((F.first("n") - F.first("p") + F.count("*")).cast("int").alias("most"))
    met_all = met.drop("p").join(most, "node")
    hubs = met_all.groupBy("gram").agg(F.max(F.struct((F.col("most") / F.col("n")).alias("apt"), "node")).alias("hub")).select("gram", F.col("hub.node").alias("hub"))
    shared = written(met_all.join(hubs, "gram"), "postings")
    discard(met)

    similar_size = f"100L * least(na, nb) >= {percent}L * greatest(na, nb)"
    # Nothing before the first n-gram that a pair shares is in both sets; what is left must be enough.
    enough_most = f"if(lasta <= lastb, mosta, mostb) * {100 + percent}L >= {percent}L * (na + nb)"
    enough_left = " AND ".join([*(f"(n{x} - pos{x}) * {100 + percent}L >= {percent}L * (na + nb)" for x in "ab"), enough_most])
    # Sizes of one band and the next are all that can be similar.
    band = lambda n: F.floor(F.log(F.col(n)) / F.log(F.lit(100 / percent)))

    def linked(pairs: DataFrame) -> DataFrame:
        """(a, b), written: those of the pairs that are similar enough. Only the sets of the pairs' nodes, and a few more, are made and moved."""
        pairs = written(pairs.select("a", "b", "na", "nb").distinct(), "pairs")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = written(nodes.join(owners, "node").select(F.col("doc_id").alias("id")).distinct(), "ids")
        wanted = context.broadcast(filter_of(ids, ids.count()))
        sets = written(texts.mapInArrow(_cut(order, wanted, borders, k), "node long, fragment int, grams array<long>"), "sets")
        more = _linked(pairs, sets, percent)
        for used in (pairs, ids, sets):
            discard(used)
        return more

    # Rows of one doc_id are linked as they are.
    twice = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").drop("z")
    tables = [written(twice.join(known, "doc_id").where("a != node").select("a", F.col("node").alias("b")).distinct(), "links")]

    # Only for connecting most nodes early: each node with the hub that it shares most of its prefix with.
    own = ["n", "most", "last"]
    seen = shared.where("node != hub").groupBy("node", *own, "hub").agg(F.count("*").alias("common"))
    best = seen.groupBy("node", *own).agg(F.max(F.struct("common", "hub")).alias("best")).where(f"4 * best.common > n * {100 - percent} DIV 100")
    first = best.select(F.col("best.hub").alias("a"), F.col("node").alias("b"), *(F.col(c).alias(f"{c}b") for c in own))
    sizes = shared.where("node = hub").select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}a") for c in own)).distinct()
    tables.append(linked(first.join(sizes, "a").where(similar_size).where(enough_most)))
    links = tables[0].unionByName(tables[1])
    found = connected_components(links, "a", "b")

    # Pairs of nodes that aren't connected yet: with one well connected node of each bucket, another one each turn, until few pairs are left; then these.
    gained = True
    for turn in range(HUB_TURNS + 1):
        placed = shared.select("gram", "node", *own, "pos").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        placed = placed.join(degree, "node", "left").fillna(0, ["links"])
        apt = F.col("links") if turn == 0 else F.least(F.col("links"), F.lit(CONNECTED))
        hub = F.struct(apt.alias("apt"), F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "component", *own, "pos")
        buckets = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(hub).alias("hub"), F.count("*").alias("m"))
        side = placed.join(buckets.where("low != high").select("gram", "hub", "m"), "gram").where("component != hub.component")
        side = written(side.select("gram", "hub", "m", F.col("node").alias("a"), F.col("component").alias("ca"), *(F.col(c).alias(f"{c}a") for c in (*own, "pos"))), "side")
        here, ahead = side.agg(F.count("*"), F.sum("m")).first()
        last = not gained or (ahead or 0) <= FEW * here or turn == HUB_TURNS
        if last:
            # Each pair of a bucket has a node outside the component of the bucket's hub.
            other = placed.select("gram", F.col("node").alias("b"), F.col("component").alias("cb"), *(F.col(c).alias(f"{c}b") for c in (*own, "pos")))
            wide = side.withColumn("band", F.explode(F.array(*(band("na") + i for i in (-1, 0, 1)))))
            pairs = wide.join(other.withColumn("band", band("nb")), ["gram", "band"]).where("ca != cb AND (cb = hub.component OR a < b)")
        else:
            pairs = side.select("*", F.col("hub.node").alias("b"), *(F.col(f"hub.{c}").alias(f"{c}b") for c in (*own, "pos")))
        if here:
            tables.append(linked(pairs.where(similar_size).where(enough_left)))
            n_found = tables[-1].count()
            gained = n_found * 1000 >= here
            if n_found:
                links = links.unionByName(tables[-1])
                discard(found)
                found = connected_components(links, "a", "b")
        discard(side)
        if last:
            break
    for used in (shared, *tables):
        discard(used)

    placed = known.select("doc_id", "node").distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed.select("doc_id", "component").distinct(), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = members.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = settled(out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))))
    for used in (members, owners, found, placed):
        discard(used)
    return out
