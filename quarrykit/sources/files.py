"""Sources: the file inventory, and readers that become DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that the derived inventory deals out by doc_id.
_EXTENSIONS = [".pdf", ".docx", ".TXT", ".csv", ".json", ".html", ".png", ".mp3", ".zip", ".py", ".tar.gz", ""]


def inventory(documents: DataFrame) -> DataFrame:
    """Documents as files: path, root, basename, ext, bytes, mtime beside the text."""
    ext = F.get(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 12).cast("int"))
    named = documents.withColumn("ext", ext).withColumn("basename", F.concat(F.lit("doc_"), (F.col("doc_id") % 120).cast("string"), "ext"))
    folder = F.concat(F.lit("d"), (F.col("doc_id") - F.col("doc_id") % 120).cast("string"))
    return named.select(
        "doc_id", F.concat(F.lit("/"), F.concat_ws("/", "source", "lang", folder, "basename")).alias("path"), F.col("source").alias("root"),
        "basename", "ext", F.col("n_chars").alias("bytes"),
        F.timestamp_add("HOUR", (F.col("doc_id") % 700).cast("int"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("mtime"), "text", "lang",
    )


def scan_files(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = (), content: bool = False, on_missing: str = "skip") -> DataFrame:
    """Files below all roots with the label of their root; without ``content`` no byte of them is read.

    A missing root is skipped, or an error with ``on_missing="error"``.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = []
    for root in roots:
        path = hadoop.Path(root)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            there.append(root)
        elif on_missing == "error":
            raise FileNotFoundError(root)
    schema = "path string, modificationTime timestamp, length long, content binary"
    if not there:
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    if extensions:
        found = found.where(F.lower(F.regexp_extract("path", r"[^./](\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))
    label = F.lit(None).cast("string")
    for root in sorted(there, key=len):  # the longest prefix wins
        path = hadoop.Path(root)
        whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        label = F.when(F.col("path").startswith(whole.rstrip("/") + "/"), F.lit(root)).otherwise(label)
    return found.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"), label.alias("root"), *(["content"] if content else []))


def newest(files: DataFrame, pattern: str) -> DataFrame:
    """The most recent file whose path matches a regular expression."""
    return files.where(F.col("path").rlike(pattern)).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def excluding_folders(files: DataFrame, folders: Sequence[str], pattern: str = "") -> DataFrame:
    """Files that lie in none of the named folders, and whose path doesn't match."""
    kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, folders))))
    return kept.where(~F.col("path").rlike(pattern)) if pattern else kept


def visible(files: DataFrame) -> DataFrame:
    """Files without a part of the path that starts with a dot, ``.`` and ``..`` aside."""
    return files.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".") & ~p.isin(".", "..")))


def screened(files: DataFrame, name_pattern: str, most_bytes: int) -> DataFrame:
    """All files with ``accepted``: the name matches and the size is within the cap."""
    return files.withColumn("accepted", F.col("basename").rlike(name_pattern) & (F.col("bytes") <= most_bytes))


def unlocked(files: DataFrame, name: str = "basename") -> DataFrame:
    """Files that are neither locks (``~$``) nor marked as done."""
    return files.where(~F.col(name).startswith("~$") & ~F.col(name).contains("__DONE__"))


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines corpus; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_manifest(spark: SparkSession, path: str, arrays: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A JSON array of objects; missing arrays are empty."""
    schema = ", ".join([*(f"{c} string" for c in fields), *(f"{c} array<string>" for c in arrays)])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(*fields, *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in arrays))


def read_graph(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """A CSV of nodes or edges; each column is the first filled one of its aliases."""
    rows = spark.read.option("header", True).csv(path)
    first = lambda names: F.coalesce(*(F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in rows.columns), F.lit(None).cast("string"))
    return rows.select(*(first(names).alias(column) for column, names in aliases.items()))


def page_links(pages: DataFrame, target: str, form_id: str) -> DataFrame:
    """Anchors whose target matches, with an id from the anchor's text or else its target, and an absolute address."""
    anchors = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(0))).alias("position", "anchor"))
    parts = anchors.select(
        "page_id", "url", "position", F.regexp_extract("anchor", '<a href="([^"]*)">', 1).alias("href"), F.regexp_extract("anchor", ">([^<]*)</a>", 1).alias("label")
    ).where(F.col("href").rlike(target))
    found = parts.withColumn("form_id", F.replace(F.coalesce(*(F.nullif(F.regexp_extract(c, form_id, 0), F.lit("")) for c in ("label", "href"))), F.lit(" "), F.lit("-")))
    site = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    return found.where("form_id IS NOT NULL").select("page_id", "position", "form_id", F.when(F.col("href").startswith("/"), F.concat(site, "href")).otherwise(F.col("href")).alias("address"))


def matching(df: DataFrame, prefix: tuple[str, str], needle: str) -> DataFrame:
    """Rows whose column starts with a prefix and that hold a text in any column."""
    return df.where(F.col(prefix[0]).startswith(prefix[1]) & F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns)).contains(needle))


def decoded(content: Column, limit: int) -> Column:
    """Text of the first ``limit`` bytes: UTF-8 where it is valid, but for a character that the limit cuts, or else Windows-1252."""
    cut = F.substring(content, 1, limit)
    whole = [F.when(F.octet_length(content) > limit, F.try_validate_utf8(F.substring(content, 1, limit - n).cast("string"))) for n in (1, 2, 3)]
    high = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    single = F.translate(F.decode(cut, "iso-8859-1"), "".join(high), "".join(high.values()))
    return F.coalesce(F.try_validate_utf8(cut.cast("string")), *whole, single)
