"""Structured Streaming jobs: catalogue, stateful keep-oldest dedupe, first-wins dedupe, counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quarrykit.operators import dedupe
from quarrykit.operators.catalogue import Catalogue
from quarrykit.plans.tables import discard, written
from quarrykit.sources.sinks import append_ledger

#: Versions of a catalogue that stay.
KEPT = 2


def _finished(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there now to a parquet sink, from where the checkpoint left off."""
    _finished(stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start())


def catalogue(stream: DataFrame, table: str, checkpoint: str, key: str, version: str, rules: Callable[[DataFrame], DataFrame] | None = None, hits: str = "") -> None:
    """Upsert a stream of file rows into a versioned table; rule hits of the changed keys are replaced.

    Each batch writes the table anew under its own number, so that a batch that
    runs twice gives the same table; the number is part of the path.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
        old = latest(spark, table, number)
        (newest if old is None else dedupe.upsert(old, newest, key)).write.mode("overwrite").parquet(f"{table}/v{number:09d}")
        if rules is not None:
            before, found = latest(spark, hits, number), rules(newest)
            (found if before is None else dedupe.replace_children(before, newest, found, key)).write.mode("overwrite").parquet(f"{hits}/v{number:09d}")

        for old_table in (table, hits) if rules is not None else (table,):
            forget(spark, old_table, number, KEPT)

    _finished(stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def catalogue_changes(stream: DataFrame, table: Catalogue, checkpoint: str, version: str, rules: Callable[[DataFrame], DataFrame] | None = None, hits: Catalogue | None = None) -> None:
    """catalogue() without writing the table anew: a batch writes its own rows, and the hits of the keys it has.

    ``rules`` makes the hits of changed rows, with the key among their columns.
    Batches have the stream's numbers, so one that is sent again is left out,
    by each of the two tables on its own.
    """

    def merge(batch: DataFrame, number: int) -> None:
        key = table.key
        rest = [c for c in batch.columns if c not in (key, version)]
        newest = batch.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("__r")).select(key, "__r.*")
        newest = written(newest, "newest")
        table.replace(newest, batch=number)
        if rules is not None and hits is not None:
            hits.replace(rules(newest), newest.select(F.col(key).alias(hits.key)), batch=number)
        discard(newest)

    _finished(stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def forget(spark: SparkSession, table: str, number: int, kept: int) -> None:
    """Delete the versions of a table but the last few; a batch that runs twice needs the one before it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    for name in [n for n in names if n.startswith("v") and n <= f"v{number:09d}"][:-kept]:
        fs.delete(hadoop.Path(path, name), True)


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", most_files: int = 800) -> DataFrame:
    """A stream of the files of a folder, of which a batch takes ``most_files`` at most."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", most_files).load(path)


def budgeted_pass(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, batches: int = 1, wait: float = 300.0) -> int:
    """Work on ``batches`` batches at most, then stop; the next pass goes on where this one ended. Returns how many it did.

    The stream sets the size of a batch. Nothing new ends the pass too. ``wait``
    seconds in which no batch ends raise TimeoutError, so that a caller that goes
    on until nothing is left never takes a stuck pass for the end.
    """
    done: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        if len(done) < batches:
            work(batch, number)
            done.append(number)
        else:
            raise _Spent

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        seen = -1
        while not query.awaitTermination(wait):
            if len(done) == seen:
                raise TimeoutError(f"no batch ended in {wait} seconds; {len(done)} are done")
            seen = len(done)
    except TimeoutError:
        raise
    except Exception:  # noqa: BLE001  the batch beyond the budget ends the query on purpose; all else is raised again
        if len(done) < batches:
            raise
    finally:
        if query.isActive:
            query.stop()
    return len(done)


class _Spent(Exception):
    """A pass has done what its budget allows."""


def daemon_step(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, ledger: str, batches: int = 1) -> int:
    """One step of a service: a budgeted pass, and a line of the ledger that says how many batches it did. What calls it again is a scheduler's job."""
    done = budgeted_pass(stream, work, checkpoint, batches)
    append_ledger(stream.sparkSession.range(1).select(F.lit(done).alias("batches")), "pass", ["batches"], ledger)
    return done


def latest(spark: SparkSession, table: str, before: int = 10**9) -> DataFrame | None:
    """The last version of a table below a number."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))
    names = [n for n in names if n < f"v{before:09d}"]
    return spark.read.parquet(f"{table}/{names[-1]}") if names else None


class KeepOldest(StatefulProcessor):
    """State of a key: its oldest row so far. A later but older row takes its place; each loser is put out with the winner of then."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.winner = handle.getValueState("winner", "age timestamp, id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.winner.get() if self.winner.exists() else None
        best = None if held is None else (held[0] is None, pd.Timestamp.min if held[0] is None else pd.Timestamp(held[0]), held[1])
        out = []
        for part in rows:
            for age, own in zip(part["age"], part["id"], strict=True):
                none = pd.isna(age)
                row = (none, pd.Timestamp.min if none else pd.Timestamp(age), int(own))
                if best is None:
                    best = row
                else:
                    best, lost = min(best, row), max(best, row)
                    if lost[2] != best[2]:
                        out.append((key[0], lost[2], best[2]))
        self.winner.update((None if best[0] else best[1].to_pydatetime(), best[2]))
        yield pd.DataFrame(out, columns=["key", "loser", "winner"])

    def close(self) -> None:
        pass


def keep_oldest_stream(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(key, loser, winner) of a stream of (key string, age timestamp, id long). Needs the RocksDB state store.

    A key that nothing came for in ``ttl_ms`` is forgotten; without it the state
    holds a row for each key for good.
    """
    return stream.groupBy("key").transformWithStateInPandas(KeepOldest(ttl_ms), "key string, loser long, winner long", "append", "None" if ttl_ms is None else "ProcessingTime")


def first_wins(stream: DataFrame, text: str, time: str | None = None, within: str = "7 days") -> DataFrame:
    """The first row of each content digest; with a ``time`` column, digests are forgotten once it is ``within`` behind, and the state is bounded."""
    hashed = stream.withColumn("sha256", F.sha2(text, 256))
    return hashed.dropDuplicates(["sha256"]) if time is None else hashed.withWatermark(time, within).dropDuplicatesWithinWatermark(["sha256"])


def counters(stream: DataFrame, event: str) -> DataFrame:
    return stream.groupBy(event).count()
