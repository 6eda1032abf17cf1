"""Graphs and folder trees: neighbourhoods, bounded subgraphs, ancestors, empty folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.columns import _let
from quarrykit.plans.tables import written


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): the seeds and all that an edge joins to one."""
    out = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return seeds.select("id").unionByName(out).unionByName(back).distinct()


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def bounded_subgraph(nodes: DataFrame, edges: DataFrame, kind: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Half of ``most`` nodes of a kind, their neighbours, then others by id up to ``most``; and the edges between. A preview, so bounded."""
    seeds = nodes.where(F.col("kind") == kind).orderBy("id").limit(most // 2)
    near = neighbours(edges, seeds).join(nodes, "id", "left_semi")
    ranked = nodes.join(seeds.select("id", F.lit(0).alias("s")), "id", "left").join(near.select("id", F.lit(1).alias("m")), "id", "left")
    kept = ranked.select("id", "kind", F.coalesce("s", "m", F.lit(2)).alias("rank")).orderBy("rank", "id").limit(most)
    return kept.select("id", "kind"), between(edges, kept)


def below(parents: DataFrame, root: int, depth: int) -> DataFrame:
    """(id): what lies below a root in parents(id, parent), down to a depth.

    A level at a time, written, and without what is there already: a node is
    walked once, whatever paths lead to it, and cycles end.
    """
    level = found = written(parents.where(F.col("parent") == root).select("id").distinct(), "level")
    for _ in range(depth - 1):
        under = parents.join(level.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        level = written(under.join(found, "id", "left_anti"), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def ancestry(parents: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(id, root, depth, marked_by, cycle) for each id of parents(id, parent): the topmost folder above it and the steps to it, and
    the nearest folder of marked(id), itself included, on the way.

    Pointers are doubled, so the rounds follow the logarithm of the depth, and
    only rows that haven't arrived are written again. A parent that is no id is a
    root, as is a folder that is its own parent. When a round brings no row
    to its root, all that are left lead into cycles: they have no root and no
    depth, and ``cycle`` is the least id of the cycle they end in; it is null
    elsewhere. Of several parents of one id the least counts. Null ids are left out.
    """
    one = parents.where("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("up"))
    signs = (one.select("id").limit(0) if marked is None else marked.select("id").where("id IS NOT NULL").distinct()).withColumn("mark", F.col("id"))
    one = written(one.withColumn("up", F.coalesce("up", "id")), "parents")
    above = one.select(F.col("up").alias("id")).distinct().join(one.select("id"), "id", "left_anti")
    nodes = one.withColumn("own", F.lit(True)).unionByName(above.withColumns({"up": F.col("id"), "own": F.lit(False)})).join(signs, "id", "left")
    start = written(nodes.select("id", "up", "own", "mark", (F.col("id") != F.col("up")).cast("long").alias("steps"), (F.col("id") == F.col("up")).alias("done")), "doubling")
    arrived, active = start.where("done"), start.where("NOT done")
    plain = active
    while not active.isEmpty():
        far = arrived.unionByName(active).select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("mark").alias("__mark"), F.col("done").alias("__done"))
        moved = active.join(far, "up").select("id", F.col("__up").alias("up"), "own", F.coalesce("mark", "__mark").alias("mark"), (F.col("steps") + F.col("__steps")).alias("steps"), F.col("__done").alias("done"))
        moved = written(moved, "doubling")
        fresh = moved.where("done")
        if fresh.isEmpty():
            break
        arrived, active = arrived.unionByName(fresh), moved.where("NOT done")
    tree = arrived.where("own").select("id", F.col("up").alias("root"), F.col("steps").alias("depth"), F.col("mark").alias("marked_by"), F.lit(None).cast(one.schema["id"].dataType).alias("cycle"))
    left = active.count()
    if not left:
        return tree
    # Pointers of at least as many steps as rows are left end inside a cycle and have passed all of it once they began there.
    ring = written(plain.join(active.select("id"), "id", "left_semi").select("id", "up", "mark", F.col("id").alias("least")), "ring")
    for _ in range(max(1, (left - 1).bit_length())):
        far = ring.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("mark").alias("__mark"), F.col("least").alias("__least"))
        ring = written(ring.join(far, "up").select("id", F.col("__up").alias("up"), F.coalesce("mark", "__mark").alias("mark"), F.least("least", "__least").alias("least")), "ring")
    named = ring.join(ring.select(F.col("id").alias("up"), F.col("least").alias("cycle")), "up")
    nothing = {"root": F.lit(None).cast(one.schema["id"].dataType), "depth": F.lit(None).cast("long"), "marked_by": F.col("mark")}
    return tree.unionByName(named.withColumns(nothing).select("id", "root", "depth", "marked_by", "cycle"))


def outside(df: DataFrame, folder: str, parents: DataFrame, denied: DataFrame) -> DataFrame:
    """The rows of df whose folder isn't denied(id) and lies under none that is. A null folder, and one that nothing is known of, is outside unless it is denied itself."""
    under = ancestry(parents, denied).where("marked_by IS NOT NULL").select("id")
    return df.join(under.unionByName(denied.select("id")).distinct().withColumnRenamed("id", folder), folder, "left_anti")


def empty_folders(folders: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Folders without a file at any depth."""
    parts = F.split(path, "/")
    above = _let(parts, lambda p: F.transform(F.sequence(F.lit(2), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/")))
    used = files.where(F.size(parts) > 2).select(F.explode(above).alias("folder")).distinct()
    return folders.join(used, "folder", "left_anti")
