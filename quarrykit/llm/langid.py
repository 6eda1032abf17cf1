"""Language identification by nearest centroids.

A text is a TF-IDF vector of hashed byte pairs and triples of its letters, of
length one. Each language has several centroids, clustered by cosine on a
bounded sample; a text gets the language of the nearest, and is marked as
rejected where it is further away than nearly all of that language's sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan
from quarrykit.llm.store import bounded

SIZE = 2048
CENTROIDS = 4
#: Labelled rows of each language, about, that its centroids are clustered on.
EACH = 1000
#: Share of a language's sample beyond which a distance is rejected.
REJECTED = 0.005

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _counts(part: pa.RecordBatch) -> np.ndarray:
    """Rows of n-gram counts in SIZE hashed places."""
    lowered = pc.utf8_lower(part.column("text").cast(pa.large_string()).fill_null(""))
    buf, offsets = scan.buffer_of(lowered)
    rows = part.num_rows
    out = np.zeros(rows * SIZE, np.float32)
    if not buf.size:
        return out.reshape(rows, SIZE)
    a = np.where(_LETTER[buf], buf, 32).astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    for n in (2, 3):
        if a.size < n:
            continue
        h = a[: a.size - n + 1] * np.uint32(0x9E3779B1)
        for j in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[j : a.size - n + 1 + j] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) % np.uint32(SIZE)
        inside = row[: h.size] == row[n - 1 :]
        blank = (a[: h.size] == 32) & (a[1 : h.size + 1] == 32)
        keep = inside & ~blank
        out += np.bincount(row[: h.size][keep] * SIZE + h[keep], minlength=out.size)
    return out.reshape(rows, SIZE)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for part in scan.slices(batch, "text", most_rows=500):
            total += (_counts(part) > 0).sum(axis=0)
            n += part.num_rows
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, SIZE), pa.int32()), pa.array(np.concatenate([[n], total]), pa.int64())], ["place", "n"]
    )


def _sampled(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.slices(batch, "text", most_rows=500):
                v = _vectors(_counts(part), idf.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "vector"])

    return run


def _clustered(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centroids are spread out by distance."""
    centres = [v[0]]
    for _ in range(min(k, len(v)) - 1):
        centres.append(v[int(np.argmin((v @ np.stack(centres).T).max(axis=1)))])
    centres = np.stack(centres)
    for _ in range(20):
        own = (v @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                mean = v[own == i].sum(axis=0)
                centres[i] = mean / max(1e-12, np.sqrt(mean @ mean))
    return centres


def _learned(rows: pa.Table) -> pa.Table:
    """The centroids of one language, one after the other, and the least cosine that isn't rejected."""
    vectors = np.stack([np.frombuffer(x, np.float32) for x in rows.column("vector").to_pylist()])
    own = vectors[vectors.any(axis=1)]
    if not len(own):
        return pa.table({"lang": pa.array([], pa.string()), "centres": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
    own = own[np.lexsort(own[:, :8].T)]
    centres = _clustered(own, CENTROIDS)
    least = float(np.quantile((own @ centres.T).max(axis=1), REJECTED))
    return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()], pa.string()), "centres": pa.array([centres.astype(np.float32).tobytes()], pa.binary()), "least": pa.array([least])})


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, names, centres, owner, limits = model.value
        for batch in batches:
            for part in scan.slices(batch, "text", most_rows=500):
                n = part.num_rows
                lang, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
                if names:
                    near = _vectors(_counts(part), idf) @ centres.T
                    best = near.argmax(axis=1)
                    score = np.clip(near[np.arange(n), best].astype(np.float64), 0, 1)
                    lang = np.array(names, object)[owner[best]]
                    rejected = score < limits[owner[best]]
                texts = part.column("text")
                buf, offsets = scan.buffer_of(texts)
                ascii_letter = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))])
                for i in np.flatnonzero(ascii_letter[offsets[1:]] == ascii_letter[offsets[:-1]]):
                    if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
                        lang[i], score[i], rejected[i] = "und", 0.0, True
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return run


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of docs(doc_id, text).

    Document frequencies come from all of train(doc_id, text, lang), where a row
    without a doc_id only counts for these; centroids
    from about EACH rows of every language, chosen by a hash of doc_id, in a task
    for each language. score is the cosine to the nearest centroid. Null text, or text
    without a letter, gets ``und`` and 0, as does all text if nothing can be
    learned. Training rows without language or letters teach nothing. Null
    doc_ids and repeated rows are kept; ties go to the language first in order;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    train = train.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    frequency = dict(train.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n")).collect())
    n = frequency.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([frequency.get(i, 0) for i in range(SIZE)], np.float64))) + 1
    idf = idf.astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)
    # Ids are drawn before any text moves, and the few that are drawn are taken to the texts.
    share = train.groupBy("lang").agg((F.lit(EACH * 2**20) / F.count("*")).alias("share"))
    ids = train.select("doc_id", "lang").join(bounded(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < F.col("share")).select("doc_id").distinct()
    drawn = train.join(bounded(ids), "doc_id", "left_semi").select("lang", "text")
    learned = drawn.mapInArrow(_sampled(shared), "lang string, vector binary").groupBy("lang").applyInArrow(_learned, "lang string, centres binary, least double")
    names, centres, owner, limits = [], [], [], []
    for r in sorted(learned.collect(), key=lambda r: r.lang):
        centres.append(np.frombuffer(r.centres, np.float32).reshape(-1, SIZE))
        owner += [len(names)] * len(centres[-1])
        limits.append(r.least)
        names.append(r.lang)
    model = (idf, names, np.concatenate(centres) if names else None, np.array(owner, np.int64), np.array(limits))
    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(_predicted(spark.sparkContext.broadcast(model)), schema)
