"""Move plans: destinations and names that collide with nothing. Nothing is moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.columns import stem
from quarrykit.operators.dedupe import ranked, rejoined
from quarrykit.plans.tables import written


def free_names(moves: DataFrame, taken: DataFrame, order: Sequence[str]) -> DataFrame:
    """moves(folder, name, ...) with ``final``: the name, or else ``stem (n).ext`` with an n that is free.

    A number is skipped where the round before used or tried it. ``taken`` holds
    (folder, name) of what is there. Each round numbers the moves
    that are still without a name, within their folder and name, and keeps the
    names that nothing else has; moves that collide go on from a higher number.
    """
    left = ranked(moves, ["folder", "name"], order, "__n").withColumn("__n", F.col("__n") - 1)
    used = taken.select("folder", F.col("name").alias("final")).distinct()
    done = None
    while True:
        numbered = F.concat(stem(F.col("name")), F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), F.regexp_extract("name", r"[^.](\.[^.]+)$", 1))
        tried = left.withColumn("final", F.when(F.col("__n") == 0, F.col("name")).otherwise(numbered))
        # Names made from different stems may meet: the first by order has it.
        wins = tried.groupBy("folder", "final").agg(F.min(F.struct("name", *order)).alias("__w"))
        there = used.withColumn("__taken", F.lit(True))
        judged = rejoined(rejoined(tried, wins, ["folder", "final"]), there, ["folder", "final"], "left")
        # Written, so that neither the test for an end nor the next round does this one again.
        judged = written(judged.withColumn("__good", (F.col("__w") == F.struct("name", *order)) & F.col("__taken").isNull()).drop("__w", "__taken"), "judged")
        good = judged.where("__good").drop("__good", "__n")
        done = good if done is None else done.unionByName(good)
        bad = judged.where("NOT __good")
        if bad.isEmpty():
            return done
        # Past all numbers that this name was given in the round, so that no two of its moves meet again.
        most = judged.groupBy("folder", "name").agg((F.max("__n") + 1).alias("__most"))
        used = written(used.unionByName(good.select("folder", "final")).distinct(), "used")
        left = ranked(rejoined(bad.drop("__good", "__n", "final"), most, ["folder", "name"]), ["folder", "name"], order, "__n").withColumn("__n", F.col("__n") - 1 + F.col("__most")).drop("__most")
