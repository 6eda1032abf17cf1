"""A log of changes to a folder of tables, which outlives a session and says what of the folder counts.

Each change is one more small file that holds the whole state, created and never
replaced. Tables are written before the change that names them, so a job that
fails half-way leaves folders that nothing names, and no reader sees them. Two
writers can't both make the same change: the second finds its file there and
fails. That holds on file systems whose create is exclusive, as HDFS's is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Log:
    """The log of a folder; ``state`` is that of its last change, or the one given if there is none yet."""

    def __init__(self, spark: SparkSession, path: str, first: dict) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.state = {"number": 0, **first}
        fs, log = self._fs("log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []
        if names:
            self.state = json.loads(spark.read.text(f"{self.path}/log/{names[-1]}", wholetext=True).first().value)

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def folder(self, name: str) -> str:
        """A new folder for a table that a change to come will name."""
        return f"{name}/{self.state['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"

    def commit(self, **changes) -> None:
        state = {**self.state, **changes, "number": self.state["number"] + 1}
        fs, path = self._fs(f"log/{state['number']:09d}.json")
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        self.state = state

    def forget(self, name: str, kept: set[str]) -> None:
        """Delete the folders of a table that aren't among those kept; only when no reader is at an older state."""
        fs, path = self._fs(name)
        for status in fs.listStatus(path) if fs.exists(path) else ():
            if f"{name}/{status.getPath().getName()}" not in kept:
                fs.delete(status.getPath(), True)
