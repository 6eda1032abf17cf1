"""Quality classifier: perplexity under a language model of trusted text.

The model is an interpolated modified Kneser-Ney model of word pairs, counted on
all trusted documents but a part that sets the thresholds. Its counts and
weights are tables, sharded by n-gram. A document's log-probability is a sum of
one weight for each of its n-grams, since log P(w | h) is log P(w), plus the log
of h's back-off, plus a correction if the pair (h, w) is in the model. So the
n-grams of documents are joined with the weights shard by shard, and the partial
sums added up by document. The most frequent n-grams, a fixed number of them,
are broadcast and summed where the text is; a filter of fixed size leaves out
n-grams that the model doesn't have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan
from quarrykit.llm.bits import filter_of, passed
from quarrykit.llm.store import bounded, discard, written

#: One in so many trusted documents sets the thresholds, the others train.
CALIBRATE = 4
#: Occurrences in trusted text that a word or pair needs for a weight of its own; the mass of the others goes to the back-off.
CUTOFF = 2
#: N-grams that are summed where the text is.
HEAVY = 1 << 16
#: Of calibrating documents of a language, the share that may score worse than the threshold, and the slack beyond it.
QUANTILE = 0.99
SLACK = 1.25
#: A language's threshold is blended with the common one as if that had so many documents.
BLEND = 50
#: Words at the mean that each document is credited with, so that short texts aren't judged by chance.
PRIOR = 20
#: Occurrences that a task holds at a time, and that a shard has, about.
HELD, SHARD = 500_000, 2_000_000
#: Documents of a slice; their places are numbers of 16 bits.
SLICE = 60_000

START, END = np.uint64(0x1D872B41A7E15C03), np.uint64(0x3C6EF372FE94F82B)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words and ends of texts in order: hash, hash before it, row. Of all rows: how many. A text without words has none."""
    words = scan.words_of(*scan.buffer_of(part.column("text")), scan.SPACED, False)
    count = np.diff(words.first)
    full = np.flatnonzero(count)
    now = np.insert(words.hash, words.first[1:][full], END)
    row = np.insert(words.row, words.first[1:][full], full)
    before = np.concatenate([[START], now[:-1]]).astype(np.uint64)
    before[np.flatnonzero(np.diff(row, prepend=-1))] = START
    return now, before, row, count + (count > 0)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, w, n): distinct pairs of some texts at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def counted() -> pa.RecordBatch:
        now, before = (np.concatenate(x) for x in zip(*held, strict=True))
        _, at, n = np.unique(scan.folded(before, now), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(scan.signed(before[at])), pa.array(scan.signed(now[at])), pa.array(n, pa.int64())], ["h", "w", "n"])

    for batch in batches:
        for part in scan.slices(batch, "text"):
            now, before, _, _ = _tokens(part)
            held.append((now, before))
            size += now.size
            if size >= HELD:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def _gram_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, w = (batch.column(c).to_numpy().view(np.uint64) for c in "hw")
        yield pa.RecordBatch.from_arrays([pa.array(scan.signed(scan.folded(h, w))), batch.column("value"), batch.column("n")], ["gram", "value", "n"])


def discounts(n: list[int]) -> list[float]:
    """The discounts of counts 1, 2 and more, from how many n-grams have counts 1 to 4."""
    n = [max(1, x or 0) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(float(i), max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


def language_model(texts: DataFrame) -> tuple[DataFrame, float, float]:
    """(gram, value, n), written; the log-probability of a word that the model doesn't have; the log of the back-off at the start of a text.

    gram is a word or a pair, value what an occurrence adds to what an unknown
    word has, n its occurrences in texts(text).
    """

    def pairs() -> DataFrame:
        return texts.select("text").mapInArrow(_pairs, "h long, w long, n long").groupBy("h", "w").agg(F.sum("n").alias("n"))

    is_n = lambda i: (F.col("n") == i).cast("long")
    zero = F.lit(0).cast("long")
    after = F.struct(
        F.col("h").alias("word"), F.col("n").alias("n_out"), *(is_n(i).alias(f"p{i}") for i in (1, 2, 3, 4)), (F.col("n") >= 3).cast("long").alias("p3up"),
        F.when(F.col("n") >= CUTOFF, F.col("n")).otherwise(zero).alias("mass"), zero.alias("n_before"), zero.alias("n_in"),
    )
    into = F.struct(F.col("w").alias("word"), *(zero.alias(c) for c in ("n_out", "p1", "p2", "p3", "p4", "p3up", "mass")), F.lit(1).cast("long").alias("n_before"), F.col("n").alias("n_in"))
    sums = ["n_out", "p1", "p2", "p3", "p4", "p3up", "mass", "n_before", "n_in"]
    words = pairs().select(F.explode(F.array(after, into)).alias("x")).select("x.*").groupBy("word").agg(*(F.sum(c).alias(c) for c in sums))
    words = written(words, "words")

    has = F.col("n_in") >= CUTOFF
    stats = words.agg(
        *(F.sum(f"p{i}").alias(f"p{i}") for i in (1, 2, 3, 4)), *(F.sum((F.col("n_before") == i).cast("long")).alias(f"b{i}") for i in (1, 2, 3, 4)),
        F.sum("n_before").alias("types"), F.sum(has.cast("long")).alias("vocabulary"),
    ).first()
    pair_cut = discounts([stats[f"p{i}"] for i in (1, 2, 3, 4)])
    word_cut = discounts([stats[f"b{i}"] for i in (1, 2, 3, 4)])
    types, vocabulary = max(1, stats.types or 0), (stats.vocabulary or 0) + 1
    cut = lambda c, d: F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])
    own = (F.col("n_before") - cut("n_before", word_cut)) / types
    kept = words.where(has).agg(F.sum(own)).first()[0] or 0.0
    unknown = max(1e-12, 1 - kept) / vocabulary
    words = words.withColumn("p", F.when(has, own + F.lit(unknown)).otherwise(F.lit(unknown)))
    words = words.withColumn("rest", F.when(F.col("n_out") > 0, 1 - (F.col("mass") - pair_cut[1] * F.col("p2") - pair_cut[2] * F.col("p3up")) / F.col("n_out")).otherwise(1.0))

    alone = words.where(has).select(F.col("word").alias("gram"), (F.log("p") - F.log(F.lit(unknown)) + F.log("rest")).alias("value"), F.col("n_in").alias("n"))
    both = pairs().where(F.col("n") >= CUTOFF)
    both = both.join(words.select(F.col("word").alias("h"), "n_out", "rest"), "h").join(words.select(F.col("word").alias("w"), "p"), "w")
    lower = F.col("rest") * F.col("p")
    both = both.select("h", "w", (F.log((F.col("n") - cut("n", pair_cut)) / F.col("n_out") + lower) - F.log(lower)).alias("value"), "n")
    model = written(alone.unionByName(both.mapInArrow(_gram_ids, "gram long, value double, n long")), "model")
    start = words.where(F.col("word") == F.lit(int(START.view(np.int64)))).select(F.log("rest")).first()
    discard(words)
    return model, float(np.log(unknown)), start[0] if start else 0.0


def _posted(heavy, light, n_shards: int):
    """Of a slice of documents, for each shard: n-grams that its weights may have, with the documents' places. One row of a slice has its documents too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = heavy.value
        bits = light.value
        number = TaskContext.get().partitionId() << 32  # the same in each attempt, as are the texts of a slice
        held: dict[str, list] = {"grams": [], "docs": [], "meta": []}
        size = rows = 0

        def slice_of(number: int) -> pa.RecordBatch:
            grams, docs = np.concatenate(held["grams"]), np.concatenate(held["docs"])
            shard = (grams % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
            pieces = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            mine = number % n_shards
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held["meta"][0].schema) as out:
                for meta in held["meta"]:
                    out.write_batch(meta)
            which = [i for i, x in enumerate(pieces) if x.size or i == mine]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(which, pa.int32()), pa.array([number] * len(which), pa.int64()), pa.array([grams[pieces[i]].tobytes() for i in which], pa.binary()),
                    pa.array([docs[pieces[i]].tobytes() for i in which], pa.binary()), pa.array([sink.getvalue().to_pybytes() if i == mine else None for i in which], pa.binary()),
                ],
                ["shard", "slice", "grams", "docs", "meta"],
            )

        for batch in batches:
            for part in scan.slices(batch, "text"):
                now, before, row, count = _tokens(part)
                grams, places = np.concatenate([now, scan.folded(before, now)]), np.concatenate([row, row])
                total = np.zeros(part.num_rows)
                rest = np.ones(grams.size, bool)
                if known.size:
                    at = np.minimum(np.searchsorted(known, scan.signed(grams)), known.size - 1)
                    hit = known[at] == scan.signed(grams)
                    total = np.bincount(places[hit], values[at[hit]], part.num_rows)
                    rest = ~hit
                rest[rest] = passed(bits, scan.signed(grams[rest]))
                held["grams"].append(grams[rest])
                held["docs"].append((places[rest] + rows).astype(np.uint16))
                held["meta"].append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(count, pa.int64()), pa.array(total)], ["doc_id", "lang", "n", "total"]))
                size, rows = size + int(rest.sum()), rows + part.num_rows
                if size >= HELD or rows + 2000 > SLICE:
                    yield slice_of(number)
                    held, size, rows, number = {"grams": [], "docs": [], "meta": []}, 0, 0, number + 1
        if rows:
            yield slice_of(number)

    return run


def _summed(posted: pa.Table, weights: pa.Table) -> pa.Table:
    """Of each slice the sums of one shard's weights by document."""
    known, values = weights.column("gram").to_numpy(), weights.column("value").to_numpy()
    order = np.argsort(known)
    known, values = known[order], values[order]
    docs, sums = [], []
    for grams, places in zip(posted.column("grams"), posted.column("docs"), strict=True):
        grams, places = np.frombuffer(grams.as_buffer(), np.int64), np.frombuffer(places.as_buffer(), np.uint16)
        total = np.zeros(0)
        if known.size and grams.size:
            at = np.minimum(np.searchsorted(known, grams), known.size - 1)
            hit = known[at] == grams
            total = np.bincount(places[hit], values[at[hit]])
        own = np.flatnonzero(total)
        docs.append(own.astype(np.uint16).tobytes()), sums.append(total[own].astype(np.float32).tobytes())
    return pa.table({"slice": posted.column("slice"), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary()), "meta": posted.column("meta")})


def _gathered(parts: pa.Table) -> pa.Table:
    """The documents of one slice with all their sums."""
    meta = pa.ipc.open_stream(next(x for x in parts.column("meta").to_pylist() if x is not None)).read_all()
    total = meta.column("total").to_numpy().copy()
    for docs, sums in zip(parts.column("docs"), parts.column("sums"), strict=True):
        total[np.frombuffer(docs.as_buffer(), np.uint16)] += np.frombuffer(sums.as_buffer(), np.float32)
    return pa.table({"doc_id": meta.column("doc_id"), "lang": meta.column("lang"), "n_symbols": meta.column("n"), "total": pa.array(total)})


def log_probabilities(docs: DataFrame, model: DataFrame, unknown: float, start: float) -> DataFrame:
    """(doc_id, lang, n_symbols, surprise) of every row of docs(doc_id, text, lang): words and ends of text, and minus their log-probability."""
    context = docs.sparkSession.sparkContext
    ranked = F.struct("n", "gram")
    top = model.orderBy(F.desc("n"), F.desc("gram")).limit(HEAVY).toArrow().sort_by("gram")
    heavy = context.broadcast((top.column("gram").to_numpy(), top.column("value").to_numpy()))
    rest = model
    if top.num_rows:
        n = top.column("n").to_numpy()
        least = (int(n.min()), int(top.column("gram").to_numpy()[n == n.min()].min()))
        rest = model.where(ranked < F.struct(F.lit(least[0]).cast("long").alias("n"), F.lit(least[1]).cast("long").alias("gram")))
    n_model = model.count()
    light = context.broadcast(filter_of(rest.select(F.col("gram").alias("id")), n_model))
    # Shards are so many that the weights of each, and about as many occurrences as documents have words, stay bounded.
    n_shards = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_model // SHARD, docs.count() * 200 // SHARD)
    posted = docs.select("doc_id", "text", "lang").mapInArrow(_posted(heavy, light, n_shards), "shard int, slice long, grams binary, docs binary, meta binary")
    weights = rest.select(F.pmod(F.conv(F.hex("gram"), 16, 10).cast("decimal(20,0)"), F.lit(n_shards)).cast("int").alias("shard"), "gram", "value")
    sums = posted.groupBy("shard").cogroup(weights.groupBy("shard")).applyInArrow(_summed, "slice long, docs binary, sums binary, meta binary")
    out = sums.groupBy("slice").applyInArrow(_gathered, "doc_id long, lang string, n_symbols long, total double")
    surprise = F.when(F.col("n_symbols") > 0, -(F.col("total") + F.col("n_symbols") * F.lit(unknown) + F.lit(start))).otherwise(F.lit(0.0))
    return out.select("doc_id", "lang", "n_symbols", surprise.alias("surprise"))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, score, threshold, accepted) for every row of docs(doc_id, text, lang).

    Trusted are the labelled documents of quality 1 that aren't toxic. The model
    is trained on all but one in CALIBRATE of them. score is the perplexity of a
    word, with PRIOR words at the mean of the calibrating documents added; a
    document is accepted up to SLACK times the QUANTILE of their scores, by
    language, blended with the quantile over all languages.

    Null or blank text scores the mean and is accepted; so is all text if
    nothing is trusted. A null language takes the common threshold. Null doc_ids
    and repeated rows are kept as rows of their own; a label that repeats counts
    once, and one of a repeated doc_id counts for all its rows. Very long texts
    are scored whole. Other columns are ignored; an empty table gives no rows.
    The scores are computed before this returns.
    """
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0
    model, unknown, start = language_model(docs.select("doc_id", "text").join(bounded(trusted.where(~held)), "doc_id", "left_semi"))
    scored = written(log_probabilities(docs, model, unknown, start), "scores")
    discard(model)
    known = scored.where("doc_id IS NOT NULL AND n_symbols > 0").join(trusted.where(held), "doc_id", "left_semi")
    mean = known.agg(F.sum("surprise") / F.sum("n_symbols")).first()[0] or 0.0
    rate = f"(surprise + {PRIOR} * {mean!r}) / (n_symbols + {PRIOR})"
    quantile = SLACK * F.percentile_approx(F.expr(f"exp({rate})"), QUANTILE, 10_000)
    common = known.agg(quantile.alias("t")).first().t
    common = float("inf") if common is None else common
    blended = ((F.count("*") * quantile + F.lit(BLEND * common)) / (F.count("*") + BLEND)).alias("threshold")
    own = known.where("lang IS NOT NULL").groupBy("lang").agg(blended)
    judged = scored.join(bounded(own), "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(common)))
    return judged.selectExpr(
        "doc_id", "lang", "n_symbols", "exp(surprise / greatest(n_symbols, 1)) AS perplexity", f"exp({rate}) AS score", "threshold", f"exp({rate}) <= threshold AS accepted"
    )
