"""A catalogue that lasts: a batch writes the rows it changes and no others.

The table is a base and the batches since. A batch is two small tables: the keys
it speaks for, and the rows that they have from now on, none for a key that is
gone. A reader leaves out what a later batch speaks for; compact() makes one base
of all. Keys may have many rows, as hits of rules have; null is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators.dedupe import MOST_KEYS
from quarrykit.plans.log import Log
from quarrykit.plans.tables import written


class Catalogue:
    """The catalogue in a folder, by a key column. Open it anew to see what others have written since."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.key = spark, key
        self.log = Log(spark, path, {"base": None, "batches": [], "schema": None, "last": -1})

    def _table(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.log.path}/{folder}")

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, batch: int | None = None) -> bool:
        """From now on the keys have these rows; without ``keys`` they are those of the rows.

        A numbered batch that is in already, or that a later one has followed, is
        left out and False returned: a stream may send its last batch again.
        """
        state = self.log.state
        if batch is not None and batch <= state["last"]:
            return False
        folders = self.log.folder("keys"), self.log.folder("rows")
        schema = state["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        names = self.spark.createDataFrame([], schema).columns
        if set(names) != set(rows.columns):
            raise ValueError(f"the catalogue has the columns {names}, not {rows.columns}")
        rows.select(*names).write.parquet(f"{self.log.path}/{folders[1]}")
        # The keys come from the rows that were written, since another run of the plan might give others.
        own = self._table(folders[1], schema) if keys is None else keys
        own.select(self.key).distinct().write.parquet(f"{self.log.path}/{folders[0]}")
        self.log.commit(batches=[*state["batches"], folders], schema=schema, last=state["last"] if batch is None else batch)
        return True

    def upsert(self, rows: DataFrame, version: str, batch: int | None = None) -> bool:
        """replace() by the row of the greatest version of each key; a missing version is least, and of equals the greatest row counts."""
        rest = [c for c in rows.columns if c not in (self.key, version)]
        latest = rows.groupBy(self.key).agg(F.max(F.struct(version, *rest)).alias("__r")).select(self.key, "__r.*")
        return self.replace(latest.select(*rows.columns), batch=batch)

    def remove(self, keys: DataFrame, batch: int | None = None) -> bool:
        """Take all rows of these keys out of a catalogue that has had rows."""
        return self.replace(self.spark.createDataFrame([], self.log.state["schema"]), keys, batch)

    def read(self) -> DataFrame:
        """The rows that count. The base isn't shuffled while the batches since speak for a million keys at most."""
        state = self.log.state
        if state["schema"] is None:
            raise ValueError("nothing was ever written to this catalogue")
        kind = dict(self.spark.createDataFrame([], state["schema"]).dtypes)[self.key]
        base = self._table(state["base"], state["schema"]) if state["base"] else self.spark.createDataFrame([], state["schema"])
        if not state["batches"]:
            return base
        keys = rows = None
        for n, (k, r) in enumerate(state["batches"]):
            said, made = (self._table(f, s).withColumn("__batch", F.lit(n)) for f, s in ((k, f"`{self.key}` {kind}"), (r, state["schema"])))
            keys, rows = (said, made) if keys is None else (keys.unionByName(said), rows.unionByName(made))
        last = keys.groupBy(F.col(self.key).alias("__key")).agg(F.max("__batch").alias("__last"))
        few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
        last = F.broadcast(last) if few else last
        same = F.col(self.key).eqNullSafe(F.col("__key"))
        now = rows.join(last, same & (F.col("__batch") == F.col("__last")), "left_semi").drop("__batch")
        return base.join(last, same, "left_anti").unionByName(now)

    def compact(self) -> None:
        """One base of the base and all batches. Folders of before stay for their readers until forget()."""
        folder = self.log.folder("base")
        self.read().write.parquet(f"{self.log.path}/{folder}")
        self.log.commit(base=folder, batches=[])

    def forget(self) -> None:
        """Delete what the last change no longer names."""
        state = self.log.state
        self.log.forget("base", {state["base"]})
        for i, name in enumerate(("keys", "rows")):
            self.log.forget(name, {b[i] for b in state["batches"]})


def fill_vault(vault: Catalogue, files: DataFrame, size: str) -> int:
    """Put into a vault, a catalogue by path, the files that it lacks or holds in another size; returns how many that were.

    What is there with the same path and size stays and isn't read from
    ``files``: only paths and sizes are compared, and content moves for new rows
    alone. Where nothing is new, nothing is written. Of several files of one path
    the one of the greatest size counts; a null path is a path, a null size a size.
    """
    path = vault.key
    wanted = files.groupBy(F.col(path).alias("__path")).agg(F.max(size).alias("__size"))
    if vault.log.state["schema"] is not None:
        there = vault.read().select(F.col(path).alias("__there"), F.col(size).alias("__held"))
        wanted = wanted.join(there, F.col("__path").eqNullSafe(F.col("__there")) & F.col("__size").eqNullSafe(F.col("__held")), "left_anti")
    wanted = written(wanted, "wanted")
    n = wanted.count()
    if n:
        small = F.broadcast(wanted) if n <= MOST_KEYS else wanted
        fresh = files.join(small, F.col(path).eqNullSafe(F.col("__path")) & F.col(size).eqNullSafe(F.col("__size")), "left_semi")
        vault.upsert(fresh, size)
    return n


def listing_changes(known: DataFrame, listing: DataFrame, path: str, time: str) -> DataFrame:
    """(path, change) between a catalogue and a new listing: added, gone, or changed, where the time differs. Repeated paths count with their latest time."""
    def side(df: DataFrame, own: str) -> DataFrame:
        return df.groupBy(F.col(path).alias("__path")).agg(F.max(time).alias(own), F.lit(True).alias(f"{own}_there"))

    both = side(known, "__old").join(side(listing, "__new").withColumnRenamed("__path", "__other"), F.col("__path").eqNullSafe(F.col("__other")), "full")
    change = (
        F.when(F.col("__old_there").isNull(), "added").when(F.col("__new_there").isNull(), "gone")
        .when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    )
    return both.select(F.coalesce("__path", "__other").alias(path), change.alias("change")).where("change IS NOT NULL")
