"""A positional inverted index that lasts: immutable segments in a folder, read by the buckets of the terms that are asked.

A segment has a row for each (term, document) with its positions, in folders by
bucket of the term's hash, sorted by term; and a dictionary of its terms. A change
is one more file of the log, created and never replaced: it names the segments
that count and the tables of deleted ids. An id that is added again hides its older
rows, as a deleted one does. Two writers can't both make the same change: the
second finds its file there and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions.columns import terms_of

#: Folders of a segment by the hash of the term.
BUCKETS = 64
#: Bytes of text for each of which there is a file, so that a task's share stays the same; a term that all documents have is in many.
PART = 8_000_000
#: Bytes of text of a task that makes postings, which it holds at ten times that until its shuffle is written.
TEXTS = 2 * PART
#: Deleted ids that are broadcast at most.
MOST = 1_000_000


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, positions) of (id, texts), a text as its words: each term of a row once, so that no position is a row of a shuffle."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = part.column(1)
            words = texts.flatten()
            size = np.asarray(pc.list_value_length(words), np.int64)
            row = np.repeat(np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(texts), np.int64)), size)
            if not row.size:
                continue
            position = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
            coded = words.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            key = row * len(coded.dictionary) + code
            order = np.lexsort((position, key))
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            offsets = pa.array(np.append(first, row.size).astype(np.int32))
            positions = pa.ListArray.from_arrays(offsets, pa.array(position[order].astype(np.int32)))
            lead = order[first]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[lead])), coded.dictionary.take(pa.array(code[lead])), positions], ["id", "term", "positions"])


class TextIndex:
    """The index in a folder; ids are of any type, terms as columns.terms_of gives them. Null ids and texts have no terms."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.state = self._latest() or {"buckets": buckets, "number": 0, "segments": {}, "deleted": {}}

    # The log

    def _fs(self, name: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _latest(self) -> dict | None:
        fs, log = self._fs("log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []
        return json.loads(self.spark.read.text(f"{self.path}/log/{names[-1]}", wholetext=True).first().value) if names else None

    def _commit(self, **changes: dict) -> None:
        state = {**self.state, **changes, "number": self.state["number"] + 1}
        fs, path = self._fs(f"log/{state['number']:09d}.json")
        out = fs.create(path, False)  # fails if another writer was first
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        self.state = state

    # Changes

    def add(self, docs: DataFrame, name: str, text: str) -> None:
        """A segment of docs; rows of ids that are there already are hidden. Repeated ids of one call are one document, its terms joined."""
        number = self.state["number"] + 1
        folder = f"{number:09d}-{uuid.uuid4().hex[:8]}"
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        rows = docs.where(F.col(name).isNotNull()).select(F.col(name).alias("id"), F.col(text).alias("text"))
        again = not rows.groupBy("id").count().where("count > 1").isEmpty()
        rows = rows.repartition(self._tasks(size), "id").select("id", terms_of(F.col("text")).alias("words"))
        texts = rows.groupBy("id").agg(F.collect_list("words").alias("texts")) if again else rows.select("id", F.array("words").alias("texts"))
        lists = texts.mapInArrow(_lists, f"id {dict(rows.dtypes)['id']}, term string, positions array<int>").withColumn("bucket", self._bucket(F.col("term")))
        self._put(lists, size, folder)
        terms = self.spark.read.schema("bucket int, term string").option("basePath", f"{self.path}/postings/{folder}").parquet(f"{self.path}/postings/{folder}")
        terms.groupBy("term", "bucket").agg(F.count("*").alias("documents")).sortWithinPartitions("term").write.parquet(f"{self.path}/terms/{folder}")
        docs.where(F.col(name).isNotNull()).select(F.col(name).alias("id")).distinct().write.parquet(f"{self.path}/ids/{folder}")
        hidden = {**self.state["deleted"], f"ids/{folder}": number} if self.state["segments"] else self.state["deleted"]
        self._commit(segments={**self.state["segments"], folder: number}, deleted=hidden)

    def delete(self, ids: DataFrame, name: str) -> None:
        """Hide the documents of these ids, of all segments that are there now."""
        folder = f"deleted/{uuid.uuid4().hex}"
        ids.select(F.col(name).alias("id")).dropna().distinct().write.parquet(f"{self.path}/{folder}")
        self._commit(deleted={**self.state["deleted"], folder: self.state["number"] + 1})

    def merge(self) -> None:
        """One segment of all that is visible. The old ones stay for those who read them, until drop_old()."""
        folder = f"{self.state['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        lists, ids = self._read("postings"), self._visible(self._read("ids"))
        words = lists.agg(F.sum(F.size("positions"))).first()[0] or 0
        with self._few_files():
            self._put(self._visible(lists, -(-6 * words // PART)).drop("number"), 6 * words, folder)  # a word takes 6 bytes of text, about
        ids.select("id").write.parquet(f"{self.path}/ids/{folder}")
        made = self.spark.read.parquet(f"{self.path}/postings/{folder}")
        made.groupBy("term", "bucket").agg(F.count("*").alias("documents")).sortWithinPartitions("term").write.parquet(f"{self.path}/terms/{folder}")
        self._commit(segments={folder: self.state["number"] + 1}, deleted={})

    def _tasks(self, size: int) -> int:
        """Parts of ``size`` bytes of text: of TEXTS at most, as many as the cores if those have a megabyte each."""
        return min(-(-size // 1_000_000), max(-(-size // TEXTS), self.spark.sparkContext.defaultParallelism)) or 1

    @contextmanager
    def _few_files(self) -> Iterator[None]:
        """What runs inside reads no more files of postings in a task than TEXTS bytes of text have: one of PART takes about half, and to open it 4 MB."""
        name = "spark.sql.files.maxPartitionBytes"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, TEXTS)
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _put(self, lists: DataFrame, size: int, folder: str) -> None:
        """Write the postings of ``size`` bytes of text, about, in tasks of PART bytes or less."""
        spread = -(-size // (PART * self.state["buckets"])) or 1
        # Each share has a task of its own: hashed once more, some would meet in one, and the more of them there are the more would.
        share = F.col("bucket") * spread + F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")
        dealt = lists.repartitionById(self.state["buckets"] * spread, share)
        dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.path}/postings/{folder}")

    def drop_old(self) -> None:
        """Delete segments that no longer count; whoever read an older state must be done."""
        for kind in ("postings", "terms", "ids"):
            fs, path = self._fs(kind)
            for found in fs.listStatus(path):
                if found.getPath().getName() not in self.state["segments"] and f"{kind}/{found.getPath().getName()}" not in self.state["deleted"]:
                    fs.delete(found.getPath(), True)

    # Reads

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.state["buckets"])).cast("int")

    def _read(self, kind: str) -> DataFrame:
        """The rows of all segments that count, each with the number of its segment."""
        if not self.state["segments"]:
            raise ValueError("nothing was added to this index")
        parts = [self.spark.read.parquet(f"{self.path}/{kind}/{folder}").withColumn("number", F.lit(number)) for folder, number in self.state["segments"].items()]
        return reduce(DataFrame.unionByName, parts)

    def _visible(self, rows: DataFrame, parts: int = 0) -> DataFrame:
        """The rows whose id was not deleted later. Where the ids are too many to broadcast, rows are joined once, in ``parts`` if given."""
        deleted = [self.spark.read.parquet(f"{self.path}/{folder}").select(F.col("id").alias("__gone"), F.lit(number).alias("__since")) for folder, number in self.state["deleted"].items()]
        if not deleted:
            return rows
        gone = reduce(DataFrame.unionByName, deleted).groupBy("__gone").agg(F.max("__since").alias("__since"))
        if gone.limit(MOST + 1).count() <= MOST:
            gone = F.broadcast(gone)
        elif parts:
            rows = rows.repartition(parts, "id")
        return rows.join(gone, (F.col("id") == F.col("__gone")) & (F.col("number") < F.col("__since")), "left_anti")

    def _buckets_of(self, terms: Sequence[str]) -> list[int]:
        asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term"))
        return sorted({r.b for r in asked.select(self._bucket(F.col("term")).alias("b")).collect()})

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """(term, id, positions) of the terms; only their buckets are read."""
        found = self._read("postings").where(F.col("bucket").isin(self._buckets_of(terms)) & F.col("term").isin(list(terms)))
        return self._visible(found).select("term", "id", "positions")

    def all_of(self, terms: Sequence[str]) -> DataFrame:
        """(id): the documents that hold all terms."""
        found = self.postings(terms).groupBy("id").agg(F.count("*").alias("n"))
        return found.where(F.col("n") == len(set(terms))).select("id")

    def any_of(self, terms: Sequence[str]) -> DataFrame:
        """(id, hits): the documents that hold one of the terms or more, and how often."""
        return self.postings(terms).groupBy("id").agg(F.sum(F.size("positions")).cast("long").alias("hits"))

    def phrase(self, terms: Sequence[str]) -> DataFrame:
        """(id, hits): where the terms stand one after another. A document's lists of all terms meet in one row, not pair by pair."""
        places = {t: [i for i, x in enumerate(terms) if x == t] for t in terms}
        back = lambda i: F.transform("positions", lambda p: p - F.lit(i))
        starts = lambda t: reduce(F.array_intersect, map(back, places[t]))
        start = reduce(lambda out, t: F.when(F.col("term") == t, starts(t)).otherwise(out), places, F.lit(None).cast("array<int>"))
        rows = self.postings(list(places)).withColumn("starts", start).groupBy("id").agg(F.collect_list("starts").alias("s"))
        both = F.aggregate("s", F.get("s", F.lit(0)), F.array_intersect)
        return rows.where(F.size("s") == len(places)).select("id", F.size(both).cast("long").alias("hits")).where("hits > 0")

    def prefix(self, start: str) -> DataFrame:
        """(id): the documents with a term that begins so. The dictionary says which buckets to read."""
        named = self._read("terms").where(F.col("term").startswith(start))
        buckets = [r.bucket for r in named.select("bucket").distinct().collect()]  # as many as there are buckets at most
        return self._visible(self._read("postings").where(F.col("bucket").isin(buckets) & F.col("term").startswith(start))).select("id").distinct()

    def without(self, found: DataFrame, terms: Sequence[str]) -> DataFrame:
        """The rows of found(id, ...) whose documents hold none of the terms."""
        return found.join(self.postings(terms).select("id").distinct(), "id", "left_anti")

    def frequencies(self, terms: Sequence[str]) -> DataFrame:
        """(term, documents) from the dictionary; hidden documents count until a merge."""
        return self._read("terms").where(F.col("term").isin(list(terms))).groupBy("term").agg(F.sum("documents").alias("documents"))
