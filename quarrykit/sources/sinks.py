"""Sinks: manifests, indexes, tables, graph import files, findings, ledgers, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.operators.payloads import ledger_rows


def write_manifest(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """As JSON and as CSV with a header, both sorted; nulls are empty in the CSV and kept in the JSON."""
    ordered = df.orderBy(*order)
    ordered.write.option("ignoreNullFields", False).json(f"{path}/json")
    ordered.write.option("header", True).option("emptyValue", "").csv(f"{path}/csv")


def write_index(df: DataFrame, path: str, compact: Sequence[str]) -> None:
    """Two JSON-lines indexes: of a few columns, and of all."""
    df.select(*compact).write.json(f"{path}/compact")
    df.write.option("ignoreNullFields", False).json(f"{path}/verbose")


def write_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (id, kind) and edges (src, dst, type) under the headers of a bulk import."""
    nodes.select(F.col("id").alias("id:ID"), F.col("kind").alias(":LABEL")).write.option("header", True).csv(f"{path}/nodes")
    names = [F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("type").alias(":TYPE")]
    edges.select(*names).write.option("header", True).csv(f"{path}/edges")


def write_findings(df: DataFrame, findings: str, path: str) -> None:
    """Only the rows that have findings."""
    df.where(F.size(findings) > 0).write.json(path)


def append_ledger(df: DataFrame, event: str, payload: list[str], path: str) -> None:
    ledger_rows(df, event, payload).write.mode("append").json(path)


def read_ledger(spark, path: str) -> DataFrame:
    return spark.read.schema("ts timestamp, event string, payload string, digest string").json(path).orderBy("ts", "digest")


def write_lines(df: DataFrame, path: str, line: str, order: Sequence[str]) -> None:
    """A column of text lines in order: checksums, calendars, reports."""
    df.orderBy(*order).select(line).write.text(path)


def run_manifest(df: DataFrame, added: str, at: str) -> DataFrame:
    """One row: how many were added and skipped, and the seconds between the first and the last."""
    seconds = F.max(at).cast("double") - F.min(at).cast("double")
    return df.agg(F.count_if(F.col(added)).alias("added"), F.count_if(~F.col(added)).alias("skipped"), F.coalesce(seconds, F.lit(0.0)).alias("seconds"))


def decoded_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(line): rows as JSON lines, with text columns that hold JSON decoded by their schemas; what can't be decoded is null."""
    return df.select(F.to_json(F.struct(*(F.from_json(c, columns[c]).alias(c) if c in columns else F.col(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def write_ledger_lines(df: DataFrame, columns: dict[str, str], path: str, order: Sequence[str]) -> None:
    """decoded_rows() as a text file of JSON lines, in order."""
    decoded_rows(df.orderBy(*order), columns).write.text(path)
