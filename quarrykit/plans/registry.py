"""The queries of the reference's own operators, each over whole tables, and their DuckDB SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrykit.functions import columns as c
from quarrykit.plans.shipping import ship
from quarrykit.sources import files as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FILES = """WITH files AS (SELECT doc_id, concat('/', source, '/', lang, '/d', CAST(doc_id - doc_id % 120 AS VARCHAR), '/', basename) AS path, source AS root, basename, ext, n_chars AS bytes,
  TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 700) * INTERVAL '1' HOUR AS mtime, text, lang
  FROM (SELECT *, concat('doc_', CAST(doc_id % 120 AS VARCHAR), ext) AS basename FROM (SELECT *, (['.pdf', '.docx', '.TXT', '.csv', '.json', '.html', '.png', '.mp3', '.zip', '.py', '.tar.gz', ''])[doc_id % 12 + 1] AS ext FROM documents))) """
EXT = r"lower(regexp_extract(basename, '[^.](\.[^.]+)$', 1))"
BUCKET = "CASE " + " ".join(f"WHEN {EXT} IN ({', '.join(repr(e) for e in v)}) THEN '{b}'" for b, v in c.BUCKETS.items()) + " ELSE 'Other' END"


class Tables:
    """The tables of a folder by name; ``files`` is the derived inventory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self._read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # A glob, which a stream of files takes for a single file as well as for a folder.
        self.stream = lambda name, schema, files=1000: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}[.]parquet")
        self.spark = spark

    def __getattr__(self, name: str) -> DataFrame:
        return src.inventory(self._read("documents")) if name == "files" else self._read(name)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return build

    return register


def simple(name: str, build: Callable[[Tables], DataFrame], sql: str) -> None:
    query(name, sql)(build)
