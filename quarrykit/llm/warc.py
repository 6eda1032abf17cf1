"""WARC derivatives: metadata and plain-text conversion records of response records.

Records are rows: type, id, target, date, the id they refer to, the block's
media type, the block and its digests. ``as_bytes`` and ``parse`` are the
file format, one gzip member for each record.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markup that ends a line, and what carries no text.
_BREAK = "(?i)<(?:/?(?:p|div|article|section|main|header|footer|nav|ul|ol|li|table|tr|h[1-6]|title|blockquote|pre|form)|br|hr)(?:[ \\t\\r\\n/][^>]*)?>"
_HIDDEN = ["(?is)<!--.*?-->", "(?is)<script[^>]*>.*?</script[^>]*>", "(?is)<style[^>]*>.*?</style[^>]*>", "(?is)<noscript[^>]*>.*?</noscript[^>]*>"]
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def plain_text(html: Column) -> Column:
    """The text of a page: no hidden parts, a line for each block, white space collapsed."""
    out = html
    for pattern in _HIDDEN:
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, "[ \\t\\r\\n]+", " ")
    out = F.regexp_replace(out, _BREAK, "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, text in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(text))
    out = F.regexp_replace(out, " +", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, " ?\n[ \n]*", "\n"), "^\n|\n$", ""))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages(page_id, url, html) as response records with an HTTP head of their own."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col("page_id").alias("source_id"), _uuid(F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each of responses(source_id, record_id, target_uri, date, block).

    Both refer to the response, keep its target and date, and concur on the
    digest of its payload. The metadata block lists the status, the source's
    headers with lower-case names, and the digests; the conversion block is the
    payload's plain text.

    A block without an HTTP head is all payload, with status 0; a null block is
    an empty one; a null target stays null. Repeated rows give repeated records;
    other columns are ignored; an empty table gives no rows.
    """
    block = F.coalesce("block", F.lit(""))
    split = F.instr(F.col("b"), "\r\n\r\n")
    is_http = F.col("b").startswith("HTTP/") & (split > 0)
    parsed = responses.select("source_id", "record_id", "target_uri", "date", block.alias("b"))
    parsed = parsed.withColumn("head", F.when(is_http, F.substring("b", F.lit(1), split - 1)).otherwise(F.lit("")))
    parsed = parsed.withColumn("payload", F.when(is_http, F.substring("b", split + 4, F.length("b"))).otherwise(F.col("b")))
    parsed = parsed.withColumn("payload_digest", F.concat(F.lit("sha256:"), F.sha2("payload", 256)))
    parsed = parsed.withColumn("source_digest", F.concat(F.lit("sha256:"), F.sha2("b", 256)))
    lines = F.filter(F.split("head", "\r\n"), lambda x: F.instr(x, ":") > 0)
    named = F.transform(lines, lambda x: F.concat(F.lit("http-header-"), F.lower(F.substring_index(x, ":", 1)), F.lit(": "), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))))
    status = F.coalesce(F.when(F.col("head") != "", F.regexp_extract("head", "^HTTP/[0-9.]+ ([0-9]+)", 1)), F.lit("0"))
    metadata = F.concat_ws(
        "\r\n", F.concat(F.lit("http-status: "), status), named, F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")),
        F.concat(F.lit("source-block-digest: "), F.col("source_digest")), F.lit(""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    rows = parsed.select("source_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.explode(kinds).alias("r"))
    return rows.select(
        "source_id", F.col("r.type").alias("warc_type"), _uuid(F.col("r.type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date",
        F.col("r.content_type").alias("content_type"), F.octet_length("r.block").cast("long").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2("r.block", 256)).alias("block_digest"), F.col("payload_digest").alias("source_payload_digest"), F.col("r.block").alias("block"),
    )


_FIELDS = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type"}


def as_bytes(records: DataFrame) -> DataFrame:
    """(record_id, warc): each record as a gzip member; members in any order make a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                block = (row["block"] or "").encode()
                head = [f"{name}: {row[key]}" for name, key in _FIELDS.items() if row.get(key)]
                head = ["WARC/1.0", *head, f"Content-Length: {len(block)}", "", ""]
                out.append(gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", mtime=0))
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(out, pa.binary())], ["record_id", "warc"])

    return records.mapInArrow(run, "record_id string, warc binary")


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, compressed or not: named headers and ``block``."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        headers["block"] = stream.read(int(headers["Content-Length"])).decode()
        yield headers


def _sql_replace(expression: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern in _HIDDEN:
        expression = f"regexp_replace({expression}, {quote(pattern)}, ' ', 'g')"
    expression = f"regexp_replace({expression}, '[ \\t\\r\\n]+', ' ', 'g')"
    expression = f"regexp_replace({expression}, {quote(_BREAK)}, chr(10), 'g')"
    expression = f"regexp_replace({expression}, '<[^>]*>', '', 'g')"
    for name, text in _ENTITIES:
        expression = f"replace({expression}, {quote(name)}, {quote(text)})"
    expression = f"regexp_replace({expression}, ' +', ' ', 'g')"
    expression = f"regexp_replace({expression}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"trim(regexp_replace({expression}, '^\\n|\\n$', '', 'g'))"


def _sql_uuid(text: str) -> str:
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({text}) AS h))"


def derivatives_sql() -> str:
    return f"""
WITH r AS (SELECT page_id AS source_id, url AS target_uri, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n,
             {_sql_uuid("concat_ws(chr(10), 'response', page_id::VARCHAR, coalesce(url, ''))")} AS refers_to FROM pages),
d AS (SELECT *, 'sha256:' || sha256(payload) AS source_payload_digest,
        'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || n || chr(13) || chr(10) || chr(13) || chr(10) || payload AS b FROM r),
k AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
        concat_ws(chr(13) || chr(10), 'http-status: 200', 'http-header-content-type: text/html; charset=utf-8', 'http-header-content-length: ' || n,
          'source-payload-digest: ' || source_payload_digest, 'source-block-digest: sha256:' || sha256(b), '') AS block FROM d
      UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {_sql_replace("payload")} FROM d)
SELECT source_id AS page_id, warc_type, {_sql_uuid("warc_type || chr(10) || refers_to")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type,
  strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_payload_digest FROM k"""
