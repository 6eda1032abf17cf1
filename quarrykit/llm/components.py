"""Connected components of an edge table, by star contraction on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.store import discard, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v, m): for every pair the least of u and of all its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of an edge with the least node that it reaches, as a written table.

    Alternates large-star and small-star steps until the edges stay the same.
    A step is a grouped minimum, combined before the shuffle, and an equi-join,
    so a hub with a great many neighbours is split like any skewed key. Nodes
    with a null and edges from a node to itself are left out.
    """
    now = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least_neighbour(large)
        then = written(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct(),
            "edges",
        )
        discard(now)
        now, after = then, _signature(then)
        if after == before:
            break
        before = after
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    found = written(found, "components")
    discard(now)
    return found
