"""Extraction payloads in JSON, their child tables, validation, snapshots of folders, and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EVENT = "struct<date:string,actor:string,action:string,location:string,details:string>"
_EXHIBIT = "struct<label:string,title:string,description:string,pages:string>"
PAYLOAD = f"parties array<struct<name:string,role:string>>, claims array<struct<title:string>>, statutes array<string>, court_rules array<string>, timeline array<{_EVENT}>, exhibits array<{_EXHIBIT}>"


def parsed(df: DataFrame, raw: str) -> DataFrame:
    """df with six arrays in place of the raw JSON; what can't be parsed gives empty ones."""
    out = df.withColumn("__p", F.from_json(raw, PAYLOAD))
    names = [part.split(" ")[0] for part in ("parties", "claims", "statutes", "court_rules", "timeline", "exhibits")]
    kinds = dict(f for f in out.select("__p.*").dtypes)
    return out.select(*(c for c in df.columns if c != raw), *(F.coalesce(F.col(f"__p.{n}"), F.array().cast(kinds[n])).alias(n) for n in names))


def children(df: DataFrame, key: str, array: str) -> DataFrame:
    """A row for each element of an array of structs; missing fields are empty."""
    rows = df.select(key, F.posexplode(array).alias("position", "__e")).select(key, "position", "__e.*")
    return rows.fillna("", [c for c in rows.columns if c not in (key, "position")])


def first_name(array: Column, field: str) -> Column:
    return F.coalesce(F.get(array, F.lit(0))[field], F.lit(""))


def issues(raw: Column, required: list[str], dates: list[str] = (), lists: list[str] = ()) -> Column:
    """What a JSON object lacks: required keys, dates that don't parse, lists that aren't lists of strings."""
    v = F.try_parse_json(raw)
    found = [F.when(v.isNull(), F.lit("not JSON"))]
    for k in required:
        found.append(F.when(v.isNotNull() & F.try_variant_get(v, f"$.{k}", "string").isNull() & F.try_variant_get(v, f"$.{k}", "variant").isNull(), F.lit(f"missing {k}")))
    for k in dates:
        text = F.try_variant_get(v, f"$.{k}", "string")
        found.append(F.when(text.isNotNull() & F.try_to_timestamp(text).isNull(), F.lit(f"not a date {k}")))
    for k in lists:
        there = F.try_variant_get(v, f"$.{k}", "variant")
        found.append(F.when(there.isNotNull() & F.try_variant_get(v, f"$.{k}", "array<string>").isNull(), F.lit(f"not a list {k}")))
    return F.array_compact(F.array(*found))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two tables of (path, sha256): added, removed or changed."""
    both = before.withColumnRenamed("sha256", "old").join(after.withColumnRenamed("sha256", "new"), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def ledger_rows(df: DataFrame, event: str, payload: list[str]) -> DataFrame:
    """Rows for an append-only ledger: time, event, its digest, and the payload as JSON."""
    return df.select(F.current_timestamp().alias("ts"), F.lit(event).alias("event"), F.to_json(F.struct(*payload)).alias("payload")).withColumn("digest", F.sha2(F.concat("event", "payload"), 256))


def with_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """df with a column that it may lack so far, as nulls."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def module_manifest(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sha256, legal_function, dependencies) of modules(path, legal_function, dependencies), with the digest of the file, if it is among files(path, sha256).

    A missing function is null, missing dependencies are an empty list.
    """
    out = with_column(with_column(modules, "legal_function", "string"), "dependencies", "array<string>")
    empty = F.array().cast("array<string>")
    return out.join(files.select("path", "sha256"), "path", "left").select("path", "sha256", "legal_function", F.coalesce("dependencies", empty).alias("dependencies"))


def manifest_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, fault) of a module manifest: missing, changed, without function, and each dependency that isn't in the manifest."""
    now = manifest.join(files.select("path", F.col("sha256").alias("now")), "path", "left")
    own = F.array_compact(
        F.array(
            F.when(F.col("now").isNull(), F.lit("missing")), F.when(F.col("now") != F.coalesce("sha256", F.lit("")), F.lit("changed")),
            F.when(F.coalesce(F.trim("legal_function"), F.lit("")) == "", F.lit("no function")),
        )
    )
    wanted = manifest.select("path", F.explode("dependencies").alias("need")).distinct()
    lost = wanted.join(manifest.select(F.col("path").alias("need")).distinct(), "need", "left_anti").select("path", F.concat(F.lit("needs "), "need").alias("fault"))
    return now.select("path", F.explode(own).alias("fault")).unionByName(lost)
