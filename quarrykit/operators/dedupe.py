"""Exact and two-phase deduplication, canonical picks, and row changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.plans.tables import written

#: Keys that are broadcast at most.
MOST_KEYS = 1_000_000
#: Rows of a key that are one array, arrays that meet as many in one place, and pairs that a task looks at, about.
BLOCK, BLOCKS, PAIRS = 128, 32, 50_000_000


def duplicate_groups(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, copies, members) of the keys that more than one row has, where a group is small enough for one row; else duplicate_members()."""
    return df.groupBy(key).agg(F.count("*").alias("copies"), F.array_sort(F.collect_list(member)).alias("members")).where("copies > 1")


def duplicate_members(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, copies, first, member): a row for each member of the keys that more than one row has, however many; nulls share a key too."""
    groups = df.groupBy(key).agg(F.count("*").alias("copies"), F.min(member).alias("first")).where("copies > 1")
    return rejoined(df.select(key, F.col(member).alias("member")), groups, [key]).select(key, "copies", "first", "member")


def rejoined(df: DataFrame, per_key: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """df with what ``per_key`` says of each key; null keys meet null keys, and no row is lost to them.

    ``per_key`` is written first: an aggregate on the very key of the join would
    bind its partitions, and AQE could not split a key with a great many rows.
    """
    own = {k: f"__k{i}" for i, k in enumerate(key)}
    side = written(per_key.withColumnsRenamed(own), "per_key")
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(side[o]) for k, o in own.items()))
    return df.join(side, same, how).drop(*own.values())


def with_canonical(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the ``name`` of the first row, by ``order``, that has the same key; null is a key like any other.

    A grouped minimum and a join, so that one key with a great many rows is
    combined before the shuffle and split after it.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(*order, F.col(name).alias("__name"))).alias("__first"))
    return rejoined(df, first, key).withColumn(f"canonical_{name}", F.col("__first.__name")).drop("__first")


def two_phase(df: DataFrame, cheap: Sequence[str], full: Column, order: Sequence[str], name: str, content: Sequence[str] = ()) -> DataFrame:
    """Canonical rows by a full hash that is only taken where the cheap key collides; null keys and null hashes are keys too.

    Colliding cheap keys are found first, without content. While they are a
    million at most they are broadcast, so the hash is taken where a row is read
    and only its value moves; beyond that rows meet them in a join. ``content``
    names columns that only the hash needs and that the result leaves out.
    """
    counts = df.groupBy(*cheap).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    own = {k: f"__c{i}" for i, k in enumerate(cheap)}
    shared = written(counts.withColumnsRenamed(own), "colliding").withColumn("__shared", F.lit(True))
    if shared.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        shared = F.broadcast(shared)
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(shared[o]) for k, o in own.items()))
    hashed = df.join(shared, same, "left").withColumn("digest", F.when(F.col("__shared"), full)).drop(*own.values(), *content)
    first = hashed.where("__shared").groupBy(*cheap, "digest").agg(F.min(F.struct(*order, F.col(name).alias("__name"))).alias("__first"))
    found = rejoined(hashed, first, [*cheap, "digest"], "left")
    return found.withColumn(f"canonical_{name}", F.when(F.col("__shared"), F.col("__first.__name")).otherwise(F.col(name))).drop("__shared", "__first")


def keep_oldest(df: DataFrame, key: str, age: str, name: str) -> DataFrame:
    """(loser, winner) for each row that isn't the oldest of its key; a missing age is youngest, and null is a key like any other."""
    first = df.groupBy(key).agg(F.min(F.struct(F.col(age).isNull(), age, name)).alias("w")).select(key, F.col(f"w.{name}").alias("winner"))
    return rejoined(df, first, [key]).where(F.col(name) != F.col("winner")).select(key, F.col(name).alias("loser"), "winner")


def differing_pairs(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(a_id, b_id): all pairs of rows of one key, the lesser ``name`` first, whose values differ. Names are unique, a null is in no pair.

    The rows of a key are dealt to blocks, and some blocks meet some others in one
    place, so a key with a great many rows is in many. A block's names follow one
    another again and again, which makes the files of the result small.
    """
    counts = written(df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__rows")).where("__rows > 1"), "counts")
    looked = counts.agg(F.sum(F.col("__rows").cast("double") * F.col("__rows"))).first()[0] or 0
    tasks = max(int(looked // PAIRS) + 1, df.sparkSession.sparkContext.defaultParallelism)
    blocks = F.ceil(F.col("__rows") / BLOCK)
    rows = df.where(F.col(name).isNotNull() & F.col(value).isNotNull()).join(counts, df[key] == counts["__key"])
    rows = rows.select("__key", F.col(name).alias("a_id"), F.col(value).alias("a_value"), F.pmod(F.xxhash64(name), blocks).cast("int").alias("a_block"), blocks.cast("int").alias("blocks"))
    place = lambda block: F.floor(block / BLOCKS).cast("int")
    met = ["__key", "a_place", "b_place"]
    a = rows.select("__key", place(F.col("a_block")).alias("a_place"), F.explode(F.sequence(place(F.col("a_block")), place(F.col("blocks") - 1))).alias("b_place"), "a_block", "a_id", "a_value")
    b = rows.groupBy("__key", F.col("a_block").alias("b_block")).agg(F.array_sort(F.collect_list(F.struct(F.col("a_id").alias("b_id"), F.col("a_value").alias("b_value")))).alias("bs"))
    b = b.select("__key", F.explode(F.sequence(F.lit(0), place(F.col("b_block")))).alias("a_place"), place(F.col("b_block")).alias("b_place"), "b_block", "bs")
    # A merge join goes through the blocks, and for each through the rows that meet it; two blocks meet once.
    pairs = b.repartition(tasks, *met).hint("merge").join(a.repartition(tasks, *met), met).where("a_block <= b_block").select("a_block", "b_block", "a_id", "a_value", F.inline("bs"))
    return pairs.where("a_value != b_value AND (a_block < b_block OR a_id < b_id)").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))


def summary(df: DataFrame, key: str, size: str) -> DataFrame:
    """One row: all, unique and duplicate rows, and their bytes."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(size).alias("s"), F.max(size).alias("one"))
    return groups.agg(
        F.sum("n").alias("total"), F.count("*").alias("unique_rows"), (F.sum("n") - F.count("*")).alias("duplicates"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.col("s") - F.col("one")), F.lit(0)).alias("duplicate_bytes"),
    )


def insert_new(old: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """old and, of each key that it lacks, the first new row."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*(c for c in fresh.columns if c != key)), F.struct(*order)).alias("r")).select(key, "r.*")
    return old.unionByName(first.select(*old.columns))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """old as it is and each new whole row once."""
    return old.unionAll(new.select(*old.columns).subtract(old))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """new rows replace those of the same key; null is a key like any other.

    A key that comes more than once in ``new`` gives one row: the one of the
    greatest ``version``, a missing one being least, and of equals the greatest row.
    """
    rest = [c for c in new.columns if c not in (key, version)]
    latest = new.groupBy(key).agg(F.max(F.struct(*([version] if version else []), *rest)).alias("__r")).select(key, "__r.*").select(*new.columns)
    there = latest.select(F.col(key).alias("__key"))
    return old.join(there, F.col(key).eqNullSafe(F.col("__key")), "left_anti").unionByName(latest)


def replace_children(children: DataFrame, changed: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of changed parents give way to the new ones."""
    return children.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def most_recent(df: DataFrame, key: str, position: str, n: int) -> DataFrame:
    """The n keys that were touched last, with their last position."""
    return df.groupBy(key).agg(F.max(position).alias("last")).orderBy(F.desc("last"), key).limit(n)


def numbered(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """df with gap-free numbers in a total order, without one task for all rows.

    Rows are ranged over partitions by the order, numbered inside them, and
    moved by the counts of the partitions before; these are a row each.
    """
    spread = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    # Written, since ranges are sampled and another run might draw other borders.
    inside = written(spread.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "numbered")
    counts = inside.groupBy("__part").agg(F.max("__n").alias("__rows"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(offsets.select("__part", "__before")), "__part").withColumn(name, F.col("__before") + F.col("__n") + (start - 1)).drop("__part", "__n", "__before")


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with each row's place in its group; a group of a great many rows is spread over tasks, and nulls are a group."""
    placed = numbered(df, [*key, *order], "__place")
    first = placed.groupBy(*key).agg(F.min("__place").alias("__first"))
    return rejoined(placed, first, key).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first")
