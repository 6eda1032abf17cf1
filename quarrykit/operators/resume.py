"""Batch work that goes on where a failed run ended.

Rows are dealt into units by a hash of their key, once, in folders. Units are worked
on in waves; the outcome of a wave is written, and then one change of the log names
its units as done. A later run takes up only units that no change names, and reads
only their folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarrykit.plans.log import Log


def resumable(df: DataFrame, key: Sequence[str], work: Callable[[DataFrame], DataFrame], path: str, units: int = 256, wave: int = 32) -> DataFrame:
    """What ``work`` makes of df, unit by unit, kept in ``path``: call it again with the same path after a failure.

    All rows of a key are in one unit, null being a key like any other, so work
    may group or join by the key; it must not look across keys. df is read in the
    first run only: later ones go on with the rows that it had then. The columns
    of df and of the outcome can't be named ``unit``. A key with a great many
    rows is dealt over several files of its unit.
    """
    if "unit" in df.columns:
        raise ValueError("a column named unit would be lost")
    spark = df.sparkSession
    log = Log(spark, path, {"input": None, "units": units, "done": {}, "schema": None})
    if log.state["input"] is None:
        folder = log.folder("input")
        unit = F.pmod(F.xxhash64(*key), F.lit(units)).cast("int")
        # Beside the unit rows are dealt by a hash of their columns, which takes hot keys apart; maps have no hash.
        spread = F.pmod(F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind)), F.lit(8))
        df.withColumn("unit", unit).repartition("unit", spread).write.partitionBy("unit").parquet(f"{log.path}/{folder}")
        log.commit(input=folder)
    there = spark.read.schema(StructType([*df.schema.fields, StructField("unit", IntegerType())])).parquet(f"{log.path}/{log.state['input']}")
    left = [u for u in range(log.state["units"]) if str(u) not in log.state["done"]]
    for at in range(0, len(left), wave):
        own = left[at : at + wave]
        folder = log.folder("output")
        # Pruned by the folders' names, so a wave reads its own units only.
        made = work(there.where(F.col("unit").isin(own)).drop("unit"))
        made.write.parquet(f"{log.path}/{folder}")
        schema = log.state["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
        log.commit(done={**log.state["done"], **{str(u): folder for u in own}}, schema=schema)
    folders = sorted(set(log.state["done"].values()))
    return spark.read.schema(log.state["schema"]).parquet(*(f"{log.path}/{f}" for f in folders))
