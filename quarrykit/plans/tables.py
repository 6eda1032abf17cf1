"""Tables written to the folder that driver and executors share.

Lineage is cut by writing a table and reading it again: unlike cached blocks
it survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, read back with the same schema; inside scratch() it goes at its end, unless it is kept."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    held = _MADE.get()
    if held is not None and not kept:
        held.append(made)
    return made


@contextmanager
def scratch() -> Iterator[None]:
    """All tables written inside are deleted at the end: what outlives it must be settled or written elsewhere by then."""
    held: list[DataFrame] = []
    token = _MADE.set(held)
    try:
        yield
    finally:
        _MADE.reset(token)
        for made in held:
            discard(made)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder, so that the tables it came from can go.

    It is a checkpoint, which Spark itself deletes once nothing refers to it, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def discard(table: DataFrame) -> None:
    """Delete a table that written() made and that nothing will read again."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
