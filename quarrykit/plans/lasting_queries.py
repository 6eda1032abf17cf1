"""Queries over what lasts between runs, ancestry of folders, and table functions from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import tables
from quarrykit.operators import catalogue, graph, resume, schema_check
from quarrykit.plans.registry import FILES, Tables, query, simple
from quarrykit.plans.tables import shared_dir
from quarrykit.streaming import jobs

# Folders: chains of 64, and a cycle of twelve with a tail in every eighth chain
_PARENT = "CASE WHEN p_partkey % 512 = 100 THEN p_partkey + 11 WHEN p_partkey % 64 = 0 THEN p_partkey {div} 64 ELSE p_partkey - 1 END"
_WALK = f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, nullif({_PARENT.format(div="//")}, p_partkey) AS parent, p_size FROM part),
  w AS (SELECT id, id AS cur, 0 AS d FROM p UNION ALL SELECT w.id, p.parent, d + 1 FROM w JOIN p ON p.id = w.cur WHERE d < 400 AND p.parent IS NOT NULL),
  a AS (SELECT w.id, max(CASE WHEN p.parent IS NULL THEN cur END) AS root, max(CASE WHEN p.parent IS NULL THEN d END)::BIGINT AS depth,
        arg_min(cur, d) FILTER (p.p_size = 7) AS marked_by, min(cur) FILTER (d >= 200) AS far FROM w LEFT JOIN p ON p.id = w.cur GROUP BY w.id) """


def _folders(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.expr(_PARENT.format(div="div")).alias("parent"))


def _denied(t: Tables) -> DataFrame:
    return t.part.where("p_size = 7").select(F.col("p_partkey").alias("id"))


simple("j11_ancestry", lambda t: graph.ancestry(_folders(t), _denied(t)), _WALK + "SELECT id, root, depth, marked_by, CASE WHEN root IS NULL THEN far END AS cycle FROM a")
simple("j11_outside_denylist", lambda t: graph.outside(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", _folders(t), _denied(t)),
       _WALK + "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM a WHERE marked_by IS NOT NULL)")

# A catalogue of files over three scans: of six files in seven, then of all with later times for some, then without those of one source
def _scans(t: Tables) -> DataFrame:
    hours = F.expr("timestampdiff(SECOND, TIMESTAMP'2024-01-01 00:00:00', mtime)")
    files = t.files.select("doc_id", "path", "bytes", hours.alias("time"), F.md5("text").alias("md5"))
    own = catalogue.Catalogue(t.spark, f"{shared_dir(t.spark)}/catalogue-{uuid.uuid4().hex}", "doc_id")
    own.upsert(files.where("doc_id % 7 != 0"), "time", batch=0)
    own.compact()
    later = files.withColumn("time", F.when(F.col("doc_id") % 10 == 3, F.col("time") + 60).otherwise(F.col("time")))
    changes = catalogue.listing_changes(own.read(), later, "doc_id", "time").where("change != 'gone'").select("doc_id")
    own.upsert(later.join(changes, "doc_id", "left_semi"), "time", batch=1)
    own.upsert(files, "time", batch=1)  # sent again: left out
    left = later.where("path NOT LIKE '/src1/%'")
    gone = catalogue.listing_changes(own.read(), left, "doc_id", "time").where("change = 'gone'").select("doc_id")
    own.remove(gone, batch=2)
    return own.read()


def _vault(t: Tables) -> DataFrame:
    """Two of three files come first; all come then, every fifth one longer; the third time nothing is new."""
    files = t.files.select("path", F.octet_length("text").cast("bigint").alias("bytes"), "text")
    longer = files.withColumn("text", F.when(F.col("bytes") % 5 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text"))).withColumn("bytes", F.octet_length("text").cast("bigint"))
    own = catalogue.Catalogue(t.spark, f"{shared_dir(t.spark)}/vault-{uuid.uuid4().hex}", "path")
    counts = [catalogue.fill_vault(own, f, "bytes") for f in (files.where("bytes % 3 != 0"), longer, longer)]
    return own.read().select("path", "bytes", F.md5("text").alias("md5")).withColumn("last_time", F.lit(counts[-1]))


simple("k07_vault_filled", _vault,
       FILES + """, l AS (SELECT path, CASE WHEN strlen(text) % 5 = 0 THEN text || '+' ELSE text END AS text FROM files)
       SELECT path, b::BIGINT AS bytes, md5(arg_max(text, text)) AS md5, 0::INT AS last_time FROM (SELECT path, text, strlen(text) AS b, max(strlen(text)) OVER (PARTITION BY path) AS m FROM l) WHERE b = m GROUP BY path, b""")
simple("x01_catalogue_of_scans", _scans,
       FILES + "SELECT doc_id, path, bytes, (doc_id % 700 * 3600 + CASE WHEN doc_id % 10 = 3 THEN 60 ELSE 0 END) AS time, md5(text) AS md5 FROM files WHERE path NOT LIKE '/src1/%'")


def _watched(t: Tables) -> DataFrame:
    """The last event of each user, and how often its kind is among the hits, from a stream of all events."""
    base = f"{shared_dir(t.spark)}/watched-{uuid.uuid4().hex}"
    table, hits = (catalogue.Catalogue(t.spark, f"{base}/{n}", "user_id") for n in ("table", "hits"))
    kinds = lambda df: df.where("event_type IN ('click', 'purchase')").select("user_id", "event_type")
    stream = t.stream("events", t.events.schema).select("user_id", "event_id", "event_type")
    jobs.catalogue_changes(stream, table, f"{base}/state", "event_id", kinds, hits)
    found = hits.read().groupBy("user_id").agg(F.count("*").alias("hits"))
    return table.read().join(found, "user_id", "left").select("user_id", "event_id", "event_type", F.coalesce("hits", F.lit(0)).alias("hits"))


simple("x01_catalogue_of_a_stream", _watched,
       "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, (arg_max(event_type, event_id) IN ('click', 'purchase'))::BIGINT AS hits FROM events GROUP BY user_id")


@query("x07_resumed_units", "SELECT l_suppkey, count(*) AS lines, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY l_suppkey")
def _(t: Tables) -> DataFrame:
    # The second wave of the first run fails; the second run has no input of its own and ends what the first one dealt.
    path = f"{shared_dir(t.spark)}/resumed-{uuid.uuid4().hex}"
    lines = t.lineitem.select("l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity"))
    waves = []

    def sums(part: DataFrame) -> DataFrame:
        return part.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))

    def failing(part: DataFrame) -> DataFrame:
        waves.append(part)
        if len(waves) == 2:
            raise InterruptedError
        return sums(part)

    try:
        resume.resumable(lines, ["l_suppkey"], failing, path, units=12, wave=4)
    except InterruptedError:
        pass
    return resume.resumable(lines.limit(0), ["l_suppkey"], sums, path, units=12, wave=4)


# Table functions
def _sql(text: str):
    def build(t: Tables) -> DataFrame:
        tables.register(t.spark)
        return t.spark.sql(text, docs=t.documents, events=t.events)

    return build


simple("f04_chunks_in_sql", _sql("SELECT doc_id, chunk, md5(part) AS md5 FROM {docs}, LATERAL text_chunks(text, 200, 160)"),
       r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, (i // 160)::INT AS chunk, md5(array_to_string(ws[i + 1:i + 200], ' ')) AS md5 FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 160)) AS i FROM w)")
_NTH = "SELECT doc_id, '{0}' AS rule, text, regexp_extract_all(text, '{1}') AS found FROM documents"
simple("f04_secrets_in_sql", _sql("SELECT doc_id, rule, start FROM {docs}, LATERAL secret_matches(text)"),
       "WITH RECURSIVE f AS (" + " UNION ALL ".join(_NTH.format(k, p) for k, p in (("token", 'token = "[0-9a-f]{40}"'), ("password", "password=[0-9a-z]+"), ("key", "AKIA[0-9A-Z]{16}")))
       + "), r AS (SELECT doc_id, rule, text, found, 1 AS n, instr(text, found[1]) - 1 AS start FROM f WHERE len(found) > 0 UNION ALL SELECT doc_id, rule, text, found, n + 1, start + length(found[n]) + instr(substr(text, start + length(found[n]) + 1), found[n + 1]) - 1 FROM r WHERE n < len(found)) SELECT doc_id, rule, start::BIGINT AS start FROM r")
simple("f04_first_rows_in_sql", _sql("SELECT * FROM first_rows(TABLE(SELECT user_id, ts, event_id FROM {events}) PARTITION BY user_id ORDER BY (ts, event_id), 3)"),
       "SELECT * FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS place FROM events) WHERE place <= 3")

# Records of orders with their lines as JSON texts, some of them broken, against a nested schema
_RECORD = {
    "type": "object", "required": ["id", "at", "customer", "lines"],
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "at": {"type": "string", "format": "date-time"},
        "customer": {"type": "object", "required": ["key"], "properties": {"key": {"type": "integer"}}, "additionalProperties": False},
        "lines": {"type": "array", "minItems": 2, "items": {"type": "object", "properties": {"quantity": {"type": "number", "maximum": 45}, "flag": {"enum": ["A", "N"]}}}},
    },
}


@query("n05_nested_validation", """WITH l AS (SELECT l_orderkey AS id, l_quantity AS q, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i FROM lineitem),
  o AS (SELECT o_orderkey AS id, o_custkey % 3 = 0 AS unnamed, o_custkey % 4 = 0 AS more, o_orderstatus = 'P' AS undated, (SELECT count(*) FROM l WHERE l.id = o_orderkey) AS n FROM orders),
  r AS (SELECT id, '$: not JSON' AS issue FROM o WHERE id % 11 = 0 UNION ALL SELECT id, '$.id: beyond the minimum 1' FROM o WHERE id < 1 UNION ALL SELECT id, '$.at: no date-time' FROM o WHERE undated
    UNION ALL SELECT id, '$.customer: missing key' FROM o WHERE unnamed UNION ALL SELECT id, '$.customer.more: not allowed' FROM o WHERE more UNION ALL SELECT id, '$.lines: beyond the minItems 2' FROM o WHERE n < 2
    UNION ALL SELECT id, '$.lines[' || i || '].quantity: beyond the maximum 45' FROM l SEMI JOIN o USING (id) WHERE q > 45 UNION ALL SELECT id, '$.lines[' || i || '].flag: not one of the allowed values' FROM l SEMI JOIN o USING (id) WHERE flag NOT IN ('A', 'N'))
  SELECT id, issue FROM r WHERE id % 11 <> 0 OR issue = '$: not JSON'""")
def _(t: Tables) -> DataFrame:
    line = F.struct("l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    when = F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'"))
    customer = F.struct(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("key"), F.when(F.col("o_custkey") % 4 == 0, "x").alias("more"))
    orders = t.orders.join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(dict(lines.dtypes)["lines"])))
    raw = F.to_json(F.struct(F.col("o_orderkey").alias("id"), when.alias("at"), customer.alias("customer"), "lines"))
    raw = F.when(F.col("o_orderkey") % 11 == 0, F.substring(raw, 1, 20)).otherwise(raw)
    return orders.select(F.col("o_orderkey").alias("id"), F.explode(schema_check.schema_issues(raw, _RECORD)).alias("issue"))
