"""Approximate nearest vectors by cosine: inverted lists around centroids, probed, then ranked exactly.

Centroids are fitted on a bounded sample and reach every row: each vector is put
into the list of its nearest centroid. A query looks into its nearest lists only.
How many these are is set on the sample, by what share of the true neighbours they
hold. Lists and queries meet in blocks of bounded size, so a list with a great
many vectors is many tasks' work, and no pair of rows is ever a row itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.plans.tables import written

#: Rows that centroids are fitted on at most, drawn by a hash of the id.
SAMPLE = 20_000
#: Share of the true neighbours in the sample that the probed lists must hold, and of how many sampled queries.
RECALL, ASKED = 0.97, 500
#: Vectors and queries of a block.
ROWS, QUERIES = 50_000, 5_000


class Lists(NamedTuple):
    """Centroids of length one, and how many lists a query looks into."""

    centroids: np.ndarray
    probes: int


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length one; a vector of zeros stays."""
    rows = np.array(column.to_pylist(), np.float64) if len(column) else np.zeros((0, 1))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def fit(vectors: DataFrame, name: str, vector: str, k: int = 5, rounds: int = 10) -> Lists:
    """Lists fitted on a sample: about the square root of its size, by spherical k-means; probes by the recall of k neighbours on it."""
    drawn = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(name).alias("h"), name).orderBy("h", name).limit(SAMPLE).select(vector).toArrow()
    points = _unit(drawn.column(0))
    if not len(points):
        return Lists(np.zeros((1, 1)), 1)
    n = max(1, int(len(points) ** 0.5))
    centroids = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (points @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    own = (points @ centroids.T).argmax(1)
    asked = points[np.linspace(0, len(points) - 1, min(ASKED, len(points))).astype(int)]
    near = np.argsort(-(asked @ points.T), axis=1)[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)  # of each list, how soon a query looks into it
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return Lists(centroids, min(n, int(needed[int(np.ceil(RECALL * needed.size)) - 1]) + 1))


def _listed(centroids, probes: int):
    """A row for each of the nearest ``probes`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column(1))
            nearest = np.argsort(-(unit @ c.T), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(batch.num_rows), nearest.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(list(unit[rows]), pa.list_(pa.float64())), pa.array(nearest.ravel().astype(np.int32))], ["id", "unit", "list"])

    return run


def _dealt(df: DataFrame, name: str, vector: str, lists: Lists, probes: int) -> DataFrame:
    kind = f"id {dict(df.dtypes)[name]}, unit array<double>, list int"
    centroids = df.sparkSession.sparkContext.broadcast(lists.centroids)  # SAMPLE bounds it
    return df.where(F.col(vector).isNotNull()).select(name, vector).mapInArrow(_listed(centroids, probes), kind)


def assigned(vectors: DataFrame, name: str, vector: str, lists: Lists) -> DataFrame:
    """(id, unit, list) of every vector that isn't null, written."""
    return written(_dealt(vectors, name, vector, lists, 1), "lists")


def _best(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names, queries = rows.column("id").combine_chunks(), asked.column("id").combine_chunks()
        out_q, out_i, out_s = [], [], []
        if rows.num_rows and asked.num_rows:
            points, order = _unit(rows.column("unit")), np.argsort(np.array(names.to_pylist(), object), kind="stable")
            points = points[order]
            for at in range(0, asked.num_rows, 500):
                scores = np.round(_unit(asked.column("unit")[at : at + 500]) @ points.T, 5)
                for i, row in enumerate(scores):
                    least = np.partition(row, -k)[-k] if row.size > k else -2.0
                    found = np.flatnonzero(row >= least)
                    found = found[np.argsort(-row[found], kind="stable")][:k]  # equal scores by id
                    out_q += [at + i] * found.size
                    out_i += order[found].tolist()
                    out_s += row[found].tolist()
        return pa.table({"query": queries.take(pa.array(out_q, pa.int64())), "id": names.take(pa.array(out_i, pa.int64())), "score": pa.array(out_s, pa.float64())})

    return run


def approximate_top(rows: DataFrame, queries: DataFrame, query: str, vector: str, lists: Lists, k: int) -> DataFrame:
    """(query, id, score, rank): of each query the k best of assigned() rows by cosine, of those in the lists that it looks into.

    Scores are rounded to five places; equal ones stand by id. A null vector asks
    nothing; one of zeros scores 0 with all.
    """
    asked = written(_dealt(queries, query, vector, lists, lists.probes), "asked")
    blocks = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = blocks(rows, ROWS, "parts").join(blocks(asked, QUERIES, "turns"), "list")
    sizes = F.broadcast(written(sizes, "sizes"))  # a row for each list
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, "list").select("list", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), spread("turns").alias("turn"), "id", "unit")
    right = asked.join(sizes, "list").select("list", spread("parts").alias("part"), F.pmod(F.xxhash64("id"), "turns").cast("int").alias("turn"), "id", "unit")
    keys = ["list", "part", "turn"]
    kind = f"query {dict(asked.dtypes)['id']}, id {dict(rows.dtypes)['id']}, score double"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), kind)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)
