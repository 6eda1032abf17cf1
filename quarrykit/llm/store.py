"""Sessions and tables of this subpackage, and columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans.shipping import ship
from quarrykit.plans.tables import discard, scratch, settled, written

__all__ = ["SETTINGS", "bounded", "computed", "discard", "prepare", "scratch", "settled", "table", "without_ids", "written"]

#: What ``prepare`` sets: the bytes of a batch that goes to or from a Python worker, since whole texts are long; and that
#: shuffle files go as soon as a query ends, since every table that is read again is written.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Rows that are broadcast at most, 16 MB of ids.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Set a session up for the operators of this subpackage: the package for its workers, and SETTINGS from here on."""
    ship(spark)
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, in a session that is set up."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(small: DataFrame) -> DataFrame:
    """``small``, an id or key and a few numbers a row, marked for broadcast if it is counted to have BROADCAST_ROWS at most."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def without_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose doc_id isn't among ids(doc_id); a null one isn't. df stays where it is if the ids are few enough."""
    return df.join(bounded(ids), "doc_id", "left_anti")


def computed(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row.

    The optimizer copies a plain expression to wherever its column is used, and
    the body of a lambda then evaluates it for each element. It doesn't copy
    what a generator gives, so the expression goes through an explode of one.
    """
    return df.select(*(F.col(c) for c in df.columns if c != name), F.explode(F.array(expression)).alias(name))
