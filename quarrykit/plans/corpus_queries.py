"""Queries over whole tables: rules, joins, groups, numbers, search, row changes, checklists, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.functions import columns as c
from quarrykit.functions import udfs
from quarrykit.operators import best, dedupe, graph, nearest, payloads, plans, rules, search, text_index
from quarrykit.plans.registry import BUCKET, EXT, FILES, Tables, query, simple
from quarrykit.plans.tables import shared_dir
from quarrykit.sources import extract, sinks
from quarrykit.streaming import jobs


def _ext():
    return c.extension(F.col("basename"))


# Sinks, as the rows that are written
simple("k03_flat_index", lambda t: t.events.select("event_id", F.array_join(F.slice(F.array_sort(F.json_object_keys("props")), 1, 30), ",").alias("keys")),
       "SELECT event_id, array_to_string(list_sort(json_keys(props))[1:30], ',') AS keys FROM events")
simple("k04_duplicate_map", lambda t: dedupe.with_canonical(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"], "doc_id").where("doc_id != canonical_doc_id").select("doc_id", "canonical_doc_id"),
       "SELECT doc_id, m AS canonical_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS m FROM documents) WHERE doc_id <> m")
simple("k05_checksums", lambda t: t.files.select(F.concat(F.sha2("text", 256), F.lit("  "), "path").alias("line")), FILES + "SELECT sha256(text) || '  ' || path AS line FROM files")
simple("k07_vault_names", lambda t: dedupe.with_canonical(t.files.withColumn("h", F.sha2("text", 256)), ["h"], ["path", "doc_id"], "doc_id").where("doc_id = canonical_doc_id").select("doc_id", c.bucket(_ext()).alias("bucket"), F.concat(c.stem(F.col("basename")), F.lit("__"), F.right("h", F.lit(10)), _ext()).alias("name")),
       FILES + rf"SELECT doc_id, {BUCKET} AS bucket, regexp_replace(basename, '([^.])\.[^.]+$', '\1') || '__' || right(sha256(text), 10) || {EXT} AS name FROM files QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY path, doc_id) = 1")
simple("k08_dated_placement", lambda t: t.files.select("doc_id", F.concat_ws("/", c.bucket(_ext()), F.date_format("mtime", "yyyy/MM/dd"), F.concat(F.substring(F.sha2("text", 256), 1, 12), _ext())).alias("dated"), F.concat(F.substring(F.sha2("text", 256), 1, 2), F.lit("/"), F.sha2("text", 256), _ext()).alias("sharded")),
       FILES + f"SELECT doc_id, {BUCKET} || '/' || strftime(mtime, '%Y/%m/%d') || '/' || substr(sha256(text), 1, 12) || {EXT} AS dated, substr(sha256(text), 1, 2) || '/' || sha256(text) || {EXT} AS sharded FROM files")
_ICS = "BEGIN:VEVENT,SUMMARY:,DTSTART:,END:VEVENT".split(",")
simple("k10_calendar_lines", lambda t: t.events.select("event_id", F.posexplode(F.array(F.lit(_ICS[0]), F.concat(F.lit(_ICS[1]), "event_type"), F.concat(F.lit(_ICS[2]), F.date_format("ts", "yyyyMMdd'T'HHmmss")), F.lit(_ICS[3]))).alias("line_no", "line")),
       f"SELECT event_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT event_id, ['{_ICS[0]}', '{_ICS[1]}' || event_type, '{_ICS[2]}' || strftime(ts, '%Y%m%dT%H%M%S'), '{_ICS[3]}'] AS l FROM events)")
simple("k11_markdown_lines", lambda t: t.files.select(F.lit(2).alias("section"), F.concat(F.lit("- `"), "path", F.lit("` ("), c.human_size(F.col("bytes")), F.lit(")")).alias("line")).unionByName(t.files.agg(F.count("*").alias("n")).select(F.lit(1).alias("section"), F.concat(F.lit("# Files: "), F.col("n").cast("string")).alias("line"))).orderBy("section", "line"),
       FILES + "SELECT 2 AS section, '- `' || path || '` (' || CASE WHEN bytes < 1024 THEN printf('%.2f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.2f KB', bytes / 1024.0) ELSE printf('%.2f MB', bytes / 1048576.0) END || ')' AS line FROM files UNION ALL SELECT 1, '# Files: ' || count(*) FROM files")
simple("k14_evidence_manifest", lambda t: t.files.select("path", F.sha2("text", 256).alias("sha256")), FILES + "SELECT path, sha256(text) AS sha256 FROM files")

# Rules and tags
_RULES = [("R1", "Token", 'token = "[0-9a-f]{40}"'), ("R2", "Mail", "[A-Za-z0-9._-]+@[a-z0-9.]+"), ("R3", "Licence", "(?i)licensed? under")]
_RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{p}')" for a, b, p in _RULES) + ") AS r(rule_id, title, pattern)"


def _rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_RULES, "rule_id string, title string, pattern string")


def _hits(t: Tables) -> DataFrame:
    """(doc_id, rule_id, title) of the table of rules, of which one doesn't compile and is skipped."""
    table = _rules(t).unionByName(t.spark.createDataFrame([("R4", "Broken", "(")], "rule_id string, title string, pattern string"))
    return rules.hits(t.documents, "doc_id", "text", table).join(table.select("rule_id", "title"), "rule_id")


simple("t01_rule_hits", lambda t: _hits(t).select("doc_id", "rule_id", "title"), f"SELECT doc_id, rule_id, title FROM documents, {_RULES_SQL} WHERE regexp_matches(text, pattern)")
simple("t03_secret_names", lambda t: t.documents.select("doc_id", F.array_join(F.array_compact(F.array(*(F.when(F.substring("text", 1, 1_000_000).rlike(p), F.lit(b)) for _, b, p in _RULES))), ",").alias("secrets")),
       "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text[1:1000000], '{p}') THEN '{b}' END" for _, b, p in _RULES) + ") AS secrets FROM documents")
_KEYWORDS = [("onth", "F-1"), ("eaux", "F-2"), ("keit", "F-3"), ("ción", "F-4"), ("onth", "F-5")]
_KEYWORDS_SQL = "(VALUES " + ", ".join(f"('{w}', '{f}')" for w, f in _KEYWORDS) + ") AS k(word, form_id)"


def _suggested(t: Tables) -> DataFrame:
    return rules.keyword_forms(t.documents, "doc_id", "text", t.spark.createDataFrame(_KEYWORDS, "word string, form_id string"))


simple("t04_form_suggestions", _suggested, f"SELECT DISTINCT doc_id, form_id FROM documents, {_KEYWORDS_SQL} WHERE contains(lower(text), word)")
simple("t05_suggestions_with_rules", lambda t: _suggested(t).join(F.broadcast(t.spark.createDataFrame([("F-1", "a, b"), ("F-2", "c")], "form_id string, rules string")), "form_id"),
       f"SELECT DISTINCT doc_id, form_id, rules FROM documents, {_KEYWORDS_SQL} JOIN (VALUES ('F-1', 'a, b'), ('F-2', 'c')) AS f(form_id, rules) USING (form_id) WHERE contains(lower(text), word)")
simple("t06_citation_id", lambda t: t.pages.select("page_id", F.replace(F.coalesce(F.nullif(F.regexp_extract("html", "<h1>([A-Z][a-z]+ ?[a-z]*)", 1), F.lit("")), F.regexp_extract("url", "([0-9]+)", 1)), F.lit(" "), F.lit("-")).alias("citation")),
       "SELECT page_id, replace(coalesce(nullif(regexp_extract(html, '<h1>([A-Z][a-z]+ ?[a-z]*)', 1), ''), regexp_extract(url, '([0-9]+)', 1)), ' ', '-') AS citation FROM pages")
simple("t07_entity_filter", lambda t: t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "Email").when(F.col("c_custkey") % 3 == 1, "Phone").otherwise("Name").alias("entity")).where(F.concat_ws(" ", F.col("c_custkey").cast("string"), "entity").contains("1")),
       "SELECT * FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Email' WHEN 1 THEN 'Phone' ELSE 'Name' END AS entity FROM customer) WHERE contains(c_custkey || ' ' || entity, '1')")

# Joins
simple("j01_links_and_evidence", lambda t: t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id").select("doc_id", "quality", "source", "lang"), "SELECT doc_id, quality, source, lang FROM labels JOIN documents USING (doc_id)")
simple("j02_transcript_links", lambda t: t.conversations.select("conv_id", "turn", "role").join(t.labels, F.col("conv_id") == F.col("doc_id")).select("conv_id", "turn", "role", "quality"),
       "SELECT conv_id, turn, role, quality FROM conversations JOIN labels ON conv_id = doc_id")
simple("j03_hits_as_list", lambda t: t.documents.select("doc_id").join(_hits(t).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("rule_id")), ",").alias("rules")), "doc_id", "left").fillna("", ["rules"]),
       f"SELECT doc_id, coalesce(rules, '') AS rules FROM documents LEFT JOIN (SELECT doc_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM documents, {_RULES_SQL} WHERE regexp_matches(text, pattern) GROUP BY doc_id) USING (doc_id)")
simple("j04_not_yet_known", lambda t: t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")


@query("j05_contradiction_pairs", FILES + "SELECT a.doc_id AS a_id, b.doc_id AS b_id FROM files a JOIN files b ON a.basename = b.basename AND a.doc_id < b.doc_id WHERE a.bytes <> b.bytes")
def _(t: Tables) -> DataFrame:
    return dedupe.differing_pairs(t.files, "basename", "doc_id", "bytes")


simple("j06_required_artifacts", lambda t: t.labels.select("doc_id").join(t.documents.select("doc_id", "n_chars"), "doc_id", "left").select("doc_id", F.when(F.col("n_chars").isNull(), "missing").when(F.col("n_chars") == 0, "empty").otherwise("ok").alias("state")),
       "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'missing' WHEN n_chars = 0 THEN 'empty' ELSE 'ok' END AS state FROM labels LEFT JOIN documents USING (doc_id)")
simple("j07_manifest_check", lambda t: t.labels.select("doc_id", F.md5(F.col("quality").cast("string")).alias("wanted")).join(t.documents.select("doc_id", F.md5((F.length("text") % 2).cast("string")).alias("now")), "doc_id", "left").select("doc_id", F.when(F.col("now").isNull(), "missing file").when(F.col("now") != F.col("wanted"), "hash mismatch").otherwise("").alias("issue")),
       "SELECT doc_id, CASE WHEN text IS NULL THEN 'missing file' WHEN md5((length(text) % 2)::VARCHAR) <> md5(quality::VARCHAR) THEN 'hash mismatch' ELSE '' END AS issue FROM labels LEFT JOIN documents USING (doc_id)")
simple("j08_in_both", lambda t: t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_semi").join(t.pages.select(F.col("page_id").alias("doc_id")), "doc_id", "left_semi"),
       "SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id) SEMI JOIN (SELECT page_id AS doc_id FROM pages) USING (doc_id)")


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.lit("Customer").alias("kind")).unionByName(t.nation.select((-1 - F.col("n_nationkey")).alias("id"), F.lit("Nation").alias("kind")))
    return nodes, t.customer.select(F.col("c_custkey").alias("src"), (-1 - F.col("c_nationkey")).alias("dst"))


_NODES = "nodes AS (SELECT c_custkey AS id, 'Customer' AS kind FROM customer UNION ALL SELECT -1 - n_nationkey, 'Nation' FROM nation), edges AS (SELECT c_custkey AS src, -1 - c_nationkey AS dst FROM customer)"
simple("j09_edges_between", lambda t: graph.between(_graph(t)[1], _graph(t)[0].where("id % 2 = 0")), f"WITH {_NODES} SELECT src, dst FROM edges WHERE src % 2 = 0 AND dst % 2 = 0")
simple("j10_neighbours", lambda t: graph.neighbours(_graph(t)[1], _graph(t)[0].where("id < 3 AND id >= -2")),
       f"WITH {_NODES}, s AS (SELECT id FROM nodes WHERE id < 3 AND id >= -2) SELECT id FROM s UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM s) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM s)")
simple("j11_below_a_root", lambda t: graph.below(t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 4).alias("parent")).where("id > 0"), 3, 12),
       "WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 4 AS parent FROM part WHERE p_partkey > 0), u AS (SELECT id, 1 AS d FROM p WHERE parent = 3 UNION ALL SELECT p.id, d + 1 FROM u JOIN p ON p.parent = u.id WHERE d < 12) SELECT DISTINCT id FROM u")
simple("j12_event_links", lambda t: t.conversations.select("conv_id", "turn", F.concat(F.replace(F.get(F.split("text", "\\."), F.lit(0)), F.lit(" "), F.lit("_")), F.lit(".docx")).alias("link")),
       "SELECT conv_id, turn, replace(string_split(text, '.')[1], ' ', '_') || '.docx' AS link FROM conversations")
simple("j13_duplicate_edges", lambda t: dedupe.with_canonical(t.documents.select("doc_id", F.md5("text").alias("h")), ["h"], ["doc_id"], "doc_id").where("doc_id != canonical_doc_id").select(F.col("doc_id").alias("src"), F.col("canonical_doc_id").alias("dst"), F.lit("DUPLICATE_OF").alias("type")),
       "SELECT doc_id AS src, m AS dst, 'DUPLICATE_OF' AS type FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS m FROM documents) WHERE doc_id <> m")
simple("j14_rename_plan", lambda t: t.part.select("p_partkey", "p_name").join(t.supplier.select(F.col("s_suppkey").alias("p_partkey"), F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("target")), "p_partkey", "left").withColumn("warning", F.col("target").isNull()),
       "SELECT p_partkey, p_name, CASE WHEN s_suppkey IS NOT NULL THEN 'supplier_' || s_suppkey END AS target, s_suppkey IS NULL AS warning FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")

# Groups
_HASHED = "WITH h AS (SELECT *, sha256(text) AS h FROM documents) "
simple("a01_duplicate_groups", lambda t: dedupe.duplicate_members(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id").select("h", "copies", F.col("first").alias("first_id"), F.col("member").alias("doc_id")),
       _HASHED + "SELECT h, n AS copies, f AS first_id, doc_id FROM (SELECT h, doc_id, count(*) OVER (PARTITION BY h) AS n, min(doc_id) OVER (PARTITION BY h) AS f FROM h) WHERE n > 1")
simple("a02_two_phase", lambda t: dedupe.two_phase(t.documents.select("doc_id", "text", "n_chars", F.left("text", F.lit(32)).alias("head")), ["n_chars", "head"], F.sha2("text", 256), ["doc_id"], "doc_id", ["text"]).select("doc_id", "canonical_doc_id"),
       "SELECT doc_id, min(doc_id) OVER (PARTITION BY n_chars, left(text, 32), sha256(text)) AS canonical_doc_id FROM documents")
simple("a03_quick_only", lambda t: dedupe.with_canonical(t.documents.select("doc_id", "n_chars", F.left("text", F.lit(32)).alias("head")), ["n_chars", "head"], ["doc_id"], "doc_id").select("doc_id", "canonical_doc_id"),
       "SELECT doc_id, min(doc_id) OVER (PARTITION BY n_chars, left(text, 32)) AS canonical_doc_id FROM documents")
simple("a04_first_seen", lambda t: dedupe.with_canonical(t.files.select("doc_id", "path", "bytes", F.sha2("text", 256).alias("h")), ["h"], ["path", "doc_id"], "doc_id").select("doc_id", F.when(F.col("doc_id") != F.col("canonical_doc_id"), F.col("canonical_doc_id")).alias("duplicate_of")),
       FILES + "SELECT doc_id, nullif(first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY path, doc_id), doc_id) AS duplicate_of FROM files")
simple("a05_duplicate_notes", lambda t: dedupe.duplicate_members(t.files.select("path", F.sha2("text", 256).alias("h")), "h", "path").where("member != first").select(F.col("first").alias("path"), F.concat(F.lit("duplicate:"), "member").alias("note")),
       FILES + "SELECT f AS path, 'duplicate:' || path AS note FROM (SELECT path, min(path) OVER (PARTITION BY sha256(text)) AS f FROM files) WHERE path <> f")
simple("a06_keep_oldest", lambda t: dedupe.keep_oldest(t.files.select("doc_id", "mtime", F.md5("text").alias("h")), "h", "mtime", "doc_id").select("loser", "winner"),
       FILES + "SELECT doc_id AS loser, w AS winner FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY mtime, doc_id) AS w FROM files) WHERE doc_id <> w")
simple("a07_insert_or_ignore", lambda t: dedupe.insert_new(t.documents.where("doc_id % 2 = 0").select("doc_id", F.md5("text").alias("h")), t.documents.select("doc_id", F.md5("text").alias("h")), "h", ["doc_id"]),
       "WITH d AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT doc_id, h FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT min(doc_id), h FROM d WHERE h NOT IN (SELECT h FROM d WHERE doc_id % 2 = 0) GROUP BY h")
simple("a08_corpus_summary", lambda t: dedupe.summary(t.documents.select(F.md5("text").alias("h"), "n_chars"), "h", "n_chars"),
       "SELECT sum(n)::BIGINT AS total, count(*) AS unique_rows, (sum(n) - count(*))::BIGINT AS duplicates, sum(s)::BIGINT AS total_bytes, sum(s - o)::BIGINT AS duplicate_bytes FROM (SELECT count(*) AS n, sum(n_chars) AS s, max(n_chars) AS o FROM documents GROUP BY md5(text))")
simple("a09_totals", lambda t: t.documents.agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes")), "SELECT count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM documents")
simple("a10_count_by_bucket", lambda t: t.files.groupBy(c.bucket(_ext()).alias("bucket")).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "bucket"), FILES + f"SELECT {BUCKET} AS bucket, count(*) AS n FROM files GROUP BY 1")
simple("a11_duplicates_per_canonical", lambda t: t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("canonical"), (F.count("*") - 1).alias("duplicates")).where("duplicates > 0").select("canonical", "duplicates"),
       "SELECT min(doc_id) AS canonical, count(*) - 1 AS duplicates FROM documents GROUP BY md5(text) HAVING count(*) > 1")
simple("a12_counters", lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).unpivot(["event_type"], ["n", "users"], "counter", "amount"),
       "SELECT event_type, 'n' AS counter, count(*) AS amount FROM events GROUP BY 1 UNION ALL SELECT event_type, 'users', count(DISTINCT user_id) FROM events GROUP BY 1")
simple("a13_empty_folders", lambda t: graph.empty_folders(t.files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct(), t.files.where("doc_id % 3 = 0").select("path")),
       FILES + ", f AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM files) SELECT folder FROM f WHERE NOT EXISTS (SELECT 1 FROM files WHERE doc_id % 3 = 0 AND starts_with(path, folder || '/'))")
simple("a15_bundle", lambda t: dedupe.with_canonical(t.files.withColumn("h", F.md5("text")), ["h"], ["path", "doc_id"], "doc_id").where("doc_id = canonical_doc_id").select("root", "path").orderBy("root", "path"),
       FILES + "SELECT root, path FROM files QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY path, doc_id) = 1")
simple("a16_narrative_input", lambda t: t.documents.orderBy("doc_id").limit(1000).select("doc_id", "source").join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("quality")), "").alias("qualities")),
       "SELECT source, count(*) AS n, coalesce(string_agg(quality::VARCHAR, '' ORDER BY quality), '') AS qualities FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 1000) LEFT JOIN labels USING (doc_id) GROUP BY source")

# Numbers and layout
simple("w01_document_ids", lambda t: dedupe.numbered(t.files.select("root", "path", "doc_id"), ["root", "path", "doc_id"], "n").select("doc_id", F.format_string("DOC-%06d", "n").alias("id")),
       FILES + "SELECT doc_id, printf('DOC-%06d', row_number() OVER (ORDER BY root, path, doc_id)) AS id FROM files")
simple("w02_bates_numbers", lambda t: dedupe.numbered(t.files.where(_ext() == ".pdf").select("path", "doc_id"), ["path", "doc_id"], "n", 1001).select("doc_id", F.concat(F.lit("EX-"), F.lpad(F.col("n").cast("string"), 7, "0")).alias("bates")),
       FILES + f"SELECT doc_id, 'EX-' || lpad((1000 + row_number() OVER (ORDER BY path, doc_id))::VARCHAR, 7, '0') AS bates FROM files WHERE {EXT} = '.pdf'")
simple("w03_exhibit_labels", lambda t: t.files.orderBy("path", "doc_id").limit(50).withColumn("n", F.row_number().over(Window.orderBy("path", "doc_id"))).select("doc_id", F.format_string("Exhibit %02d - %s", "n", "basename").alias("label")),
       FILES + "SELECT doc_id, printf('Exhibit %02d - %s', row_number() OVER (ORDER BY path, doc_id), basename) AS label FROM files ORDER BY path, doc_id LIMIT 50")


@query("w05_move_plan", FILES + f"SELECT doc_id, bucket, CASE WHEN n > 1 THEN regexp_replace(basename, '([^.])\\.[^.]+$', '\\1') || ' (' || (n - 1) || ')' || {EXT} ELSE basename END AS name, n > 1 AS renamed FROM (SELECT *, {BUCKET} AS bucket, row_number() OVER (PARTITION BY {BUCKET}, basename ORDER BY path, doc_id) AS n FROM files)")
def _(t: Tables) -> DataFrame:
    named = t.files.select("doc_id", "path", "basename", c.bucket(_ext()).alias("bucket"))
    ranked = dedupe.ranked(named, ["bucket", "basename"], ["path", "doc_id"], "n")
    name = F.when(F.col("n") > 1, F.concat(c.stem(F.col("basename")), F.lit(" ("), (F.col("n") - 1).cast("string"), F.lit(")"), _ext())).otherwise(F.col("basename"))
    return ranked.select("doc_id", "bucket", name.alias("name"), (F.col("n") > 1).alias("renamed"))


simple("w06_numbered_copies", lambda t: dedupe.ranked(t.files.select("doc_id", "path", "basename", F.md5("text").alias("h")), ["h"], ["path", "doc_id"], "n").select("doc_id", F.concat(F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("_"), "basename").alias("name")),
       FILES + "SELECT doc_id, lpad(row_number() OVER (PARTITION BY md5(text) ORDER BY path, doc_id)::VARCHAR, 2, '0') || '_' || basename AS name FROM files")
simple("w07_timeline_layout", lambda t: dedupe.numbered(t.events.select("ts", "event_id"), ["ts", "event_id"], "n").join(F.broadcast(t.events.agg(F.count("*").alias("all")))).select("event_id", ((F.col("n") - 1) * F.greatest(F.floor(1600 / F.col("all")), F.lit(100))).alias("x"), ((F.col("n") - 1) % 4 * 60).alias("y")),
       "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) * greatest(1600 // count(*) OVER (), 100) AS x, (row_number() OVER (ORDER BY ts, event_id) - 1) % 4 * 60 AS y FROM events")
simple("w08_context_budget", lambda t: search.within_budget(t.documents.select("doc_id", "n_chars"), ["doc_id"], "n_chars", 16000).select("doc_id"),
       "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS b FROM documents) WHERE b <= 16000")
simple("w09_most_recent_keys", lambda t: dedupe.most_recent(t.events, "user_id", "event_id", 50), "SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 50")
simple("w10_chunks", lambda t: t.documents.select("doc_id", F.posexplode(c.chunks(F.col("text"))).alias("chunk", "part")).select("doc_id", "chunk", F.md5("part").alias("md5")),
       r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, (i // 520)::INT AS chunk, md5(array_to_string(ws[i + 1:i + 600], ' ')) AS md5 FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 520)) AS i FROM w)")

# Search
_ORDERED = "FROM (SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'th', ''))) // 2)::BIGINT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"
simple("q01_timeline", lambda t: t.events.where("ts IS NOT NULL").select("event_id", "ts", "event_type").orderBy("ts", "event_id"), "SELECT event_id, ts, event_type FROM events WHERE ts IS NOT NULL")
simple("q02_timeline_nulls_first", lambda t: t.events.select("event_id", F.coalesce(F.when(F.col("event_id") % 4 != 0, c.iso_utc(F.col("ts"))), F.lit("")).alias("date")).orderBy("date", "event_id"),
       "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS date FROM events")
simple("q03_keyword_top", lambda t: search.keyword_top(t.documents, "doc_id", "text", "th", 20), "SELECT doc_id, score " + _ORDERED)


def _vectors(t: Tables, measure: str) -> DataFrame:
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return best.nearest_top(t.embeddings, asked, "vec_id", "embedding", "query_id", 5, measure)


_PAIRS = "SELECT q.vec_id AS query_id, v.vec_id, round({score}, 5) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0"
simple("q04_vector_top", lambda t: _vectors(t, "distance"),
       "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (" + _PAIRS.format(score="list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])") + ") QUALIFY rank <= 5")
simple("q05_cosine_top", lambda t: _vectors(t, "cosine"),
       "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (" + _PAIRS.format(score="list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])") + ") QUALIFY rank <= 5")


@query("q05_approximate")
def _(t: Tables) -> DataFrame:
    """As q05, by inverted lists; no SQL, since it may miss a neighbour: its recall is tested."""
    lists = nearest.fit(t.embeddings, "vec_id", "embedding")
    found = nearest.approximate_top(nearest.assigned(t.embeddings, "vec_id", "embedding", lists), t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", lists, 5)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "score", "rank")


@query("q06_tfidf_top", """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS x FROM documents), o AS (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d),
  p AS (SELECT doc_id, x[i] AS term FROM o UNION ALL SELECT doc_id, x[i] || ' ' || x[i + 1] FROM o WHERE i < len(x)), tf0 AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL),
  tf AS (SELECT * FROM tf0 WHERE term IN (SELECT term FROM tf0 GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 200000)),
  n AS (SELECT count(*) AS n FROM d), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN f USING (term), n),
  v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.doc_id AS query, v.doc_id, round(sum(q.weight * v.weight), 6) AS score FROM v JOIN v q USING (term) WHERE q.doc_id % 50 = 0 GROUP BY ALL) QUALIFY rank <= 5""")
def _(t: Tables) -> DataFrame:
    v = search.tfidf_vectors(t.documents, "doc_id", "text")
    asked = v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query")
    return best.sharing_top(v, asked, "doc_id", "query", 5)


_INDEX = "WITH p AS (SELECT doc_id, unnest(x) AS term, generate_subscripts(x, 1) AS position FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS x FROM documents)) "
_INDEXES: dict[tuple[str, str], str] = {}


def _index(t: Tables) -> text_index.TextIndex:
    """The index of a folder's documents, built by the first query of a session that asks for it."""
    import uuid

    key = (t.spark.sparkContext.applicationId, t.documents.inputFiles()[0])
    if key not in _INDEXES:
        path = f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
        text_index.TextIndex(t.spark, path).add(t.documents, "doc_id", "text")
        _INDEXES[key] = path
    return text_index.TextIndex(t.spark, _INDEXES[key])


def _changed_index(t: Tables, merged: bool) -> text_index.TextIndex:
    """Even documents, then the multiples of three with the text of their source in front, then without the multiples of seven."""
    import uuid

    index = text_index.TextIndex(t.spark, f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}", 16)
    index.add(t.documents.where("doc_id % 2 = 0"), "doc_id", "text")
    index.add(t.documents.where("doc_id % 3 = 0").select("doc_id", F.concat_ws(" ", "source", "text").alias("text")), "doc_id", "text")
    index.delete(t.documents.where("doc_id % 7 = 0"), "doc_id")
    if merged:
        index.merge()
        index.drop_old()
    return index


def _id(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("id", "doc_id")


_CHANGED = "WITH p AS (SELECT doc_id, unnest(x) AS term, generate_subscripts(x, 1) AS position FROM (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', source, text) ELSE text END), '[a-z0-9]{2,}') AS x FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 7 <> 0)) "
simple("q07_match_all", lambda t: _id(_index(t).all_of(["the", "and"])), _INDEX + "SELECT doc_id FROM p WHERE term IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
simple("q07_match_any", lambda t: _id(_index(t).any_of(["und", "les", "nothere"])), _INDEX + "SELECT doc_id, count(*) AS hits FROM p WHERE term IN ('und', 'les', 'nothere') GROUP BY doc_id")
simple("q07_match_phrase", lambda t: _id(_index(t).phrase(["of", "the"])), _INDEX + "SELECT a.doc_id, count(*) AS hits FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id")
simple("q07_prefix_and_not", lambda t: _id((i := _index(t)).without(i.prefix("on"), ["and"])), _INDEX + "SELECT DISTINCT doc_id FROM p WHERE term LIKE 'on%' AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'and')")
simple("q07_after_changes", lambda t: _id(_changed_index(t, False).phrase(["the", "and"])), _CHANGED + "SELECT a.doc_id, count(*) AS hits FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'the' AND b.term = 'and' GROUP BY a.doc_id")
simple("q07_after_merge", lambda t: _id((i := _changed_index(t, True)).without(i.any_of(["src1", "src2", "the"]), ["und"])), _CHANGED + "SELECT doc_id, count(*) AS hits FROM p WHERE term IN ('src1', 'src2', 'the') AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'und') GROUP BY doc_id")


@query("q08_hybrid", f"""WITH k AS (SELECT doc_id, score {_ORDERED}), a AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
  v AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS score FROM embeddings, a ORDER BY score DESC, vec_id LIMIT 20),
  r AS (SELECT doc_id, 0 AS src, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM k UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY score DESC, doc_id) FROM v)
  SELECT doc_id, src, pos FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY src, pos) = 1""")
def _(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = best.nearest_top(t.embeddings, asked, "vec_id", "embedding", "query_id", 20, "cosine").select(F.col("vec_id").alias("doc_id"), F.col("rank").alias("pos"))
    words = search.keyword_top(t.documents, "doc_id", "text", "th", 20).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    return search.fused(words, near, "doc_id")


simple("q09_context", lambda t: t.files.orderBy("doc_id").limit(8).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.lit("["), "basename", F.lit("] "), F.left("text", F.lit(4000))).alias("s")))), lambda r: r["s"]), "\n").alias("context")).select(F.md5("context").alias("md5"), F.length("context").alias("length")),
       FILES + "SELECT md5(s) AS md5, length(s)::INT AS length FROM (SELECT string_agg('[' || basename || '] ' || left(text, 4000), chr(10) ORDER BY doc_id) AS s FROM (SELECT * FROM files ORDER BY doc_id LIMIT 8))")
simple("q10_passages", lambda t: t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).select("doc_id", "paragraph", c.occurrences(F.col("line"), "th").alias("score")).groupBy("doc_id").agg(F.max(F.struct("score", -F.col("paragraph"))).alias("b")).select("doc_id", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("paragraph")),
       "WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS paragraph, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), s AS (SELECT doc_id, paragraph, ((length(lower(line)) - length(replace(lower(line), 'th', ''))) // 2)::BIGINT AS score FROM l) SELECT doc_id, score, paragraph FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, paragraph) = 1")
simple("q11_bounded_subgraph", lambda t: graph.bounded_subgraph(*_graph(t), "Customer", 100)[0],
       f"WITH {_NODES}, s AS (SELECT id FROM nodes WHERE kind = 'Customer' ORDER BY id LIMIT 50), m AS (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM s) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM s)) SELECT id, kind FROM nodes ORDER BY CASE WHEN id IN (SELECT id FROM s) THEN 0 WHEN id IN (SELECT id FROM m) THEN 1 ELSE 2 END, id LIMIT 100")
simple("q12_canonical_order", lambda t: t.files.select(c.bucket(_ext()).alias("bucket"), "basename", "path").orderBy("bucket", "basename", "path"), FILES + f"SELECT {BUCKET} AS bucket, basename, path FROM files")

# Row changes
_OLD, _NEW = "SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 = 0", "SELECT o_orderkey AS id, 'N' AS s FROM orders WHERE o_orderkey % 2 = 0"


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return orders.where("id % 3 = 0"), orders.where("id % 2 = 0").withColumn("s", F.lit("N"))


simple("u01_merge_nodes", lambda t: dedupe.insert_new(*_old_new(t), "id", ["s"]), f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT id, min(s) FROM n WHERE id NOT IN (SELECT id FROM o) GROUP BY id")
simple("u02_merge_edges", lambda t: dedupe.merge_edges(*_old_new(t)), f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL (SELECT * FROM n EXCEPT SELECT * FROM o)")
simple("u03_merge_events", lambda t: t.events.select("event_id", "ts", "event_type").unionByName(t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderstatus"), allowMissingColumns=True).orderBy("ts", "event_id"),
       "SELECT event_id, ts, event_type, NULL AS o_orderstatus FROM events UNION ALL SELECT o_orderkey, o_orderdate::TIMESTAMP, NULL, o_orderstatus FROM orders")
simple("u04_upsert", lambda t: dedupe.upsert(*_old_new(t), "id"), f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
simple("u05_replace_children", lambda t: dedupe.replace_children(t.lineitem.select("l_orderkey", "l_quantity"), t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0.0).alias("l_quantity")), "l_orderkey").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity")),
       "SELECT l_orderkey, round(sum(l_quantity), 2) AS quantity FROM (SELECT l_orderkey, l_quantity::DOUBLE AS l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
simple("u06_cascade_delete", lambda t: t.labels.join(t.documents.where("source = 'src1'").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality"), "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')")
simple("u08_reseed_queue", lambda t: dedupe.merge_edges(_old_new(t)[0].select("id"), _old_new(t)[1].select("id")), f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT id FROM o UNION ALL (SELECT id FROM n EXCEPT SELECT id FROM o)")

# Checklists and declared operators
_CHECKS = [("C1", "filed", "F"), ("C2", "open", "O"), ("C3", "part", "P")]
_CHECKS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{s}')" for a, b, s in _CHECKS) + ") AS r(code, name, status)"
simple("n04_source_records", lambda t: t.documents.select("doc_id", F.lit("document").alias("type"), F.to_json(F.struct("lang", "source")).alias("metadata")), """SELECT doc_id, 'document' AS type, '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata FROM documents""")


@query("n06_checklist", f"SELECT o_custkey, code, CASE WHEN bool_or(o_orderdate::DATE < DATE '1995-01-08') THEN 'Yes' ELSE 'No' END AS required, CASE WHEN bool_or(o_orderstatus = status) THEN 'Filed' ELSE 'Missing' END AS state FROM orders, {_CHECKS_SQL} GROUP BY o_custkey, code")
def _(t: Tables) -> DataFrame:
    # The rules are three constants: they are an array of each row, after one grouping by customer.
    held = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("held"), F.max(F.datediff(F.lit("1995-01-01").cast("date"), F.col("o_orderdate").cast("date")) > -7).alias("due"))
    rules = F.array(*(F.struct(F.lit(a).alias("code"), F.lit(s).alias("status")) for a, _, s in _CHECKS))
    return held.select("o_custkey", "held", "due", F.inline(rules)).select(
        "o_custkey", "code", F.when(F.col("due"), "Yes").otherwise("No").alias("required"), F.when(F.array_contains("held", F.col("status")), "Filed").otherwise("Missing").alias("state")
    )


simple("n07_task_queue", lambda t: t.events.where(F.col("event_type").isin("click", "purchase", "view")).select("event_id", F.lit("queued").alias("status"), c.iso_utc(F.col("ts")).alias("queued_at")),
       "SELECT event_id, 'queued' AS status, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS queued_at FROM events WHERE event_type IN ('click', 'purchase', 'view')")
simple("n08_flag_symbols", lambda t: t.labels.select("doc_id", F.when(F.col("toxic") == 1, "!").otherwise("ok").alias("symbol")), "SELECT doc_id, CASE WHEN toxic = 1 THEN '!' ELSE 'ok' END AS symbol FROM labels")
def _benchmark_rules(t: Tables) -> DataFrame:
    """A rule for each word of six letters or more of the benchmark: the word as a whole."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("rule_id")).distinct()
    return words.withColumn("pattern", F.concat(F.lit(r"\b"), "rule_id", F.lit(r"\b")))


simple("f05_rules_as_data", lambda t: rules.hits(t.documents, "doc_id", "text", _benchmark_rules(t)).groupBy("rule_id").agg(F.count("*").alias("hits")),
       r"WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS rule_id FROM benchmark) SELECT rule_id, count(*) AS hits FROM documents JOIN r ON regexp_matches(text, '(^|[^\w\x80-\x{10FFFF}])' || rule_id || '($|[^\w\x80-\x{10FFFF}])') GROUP BY rule_id")
simple("f05_rule_faults", lambda t: rules.faults(t.part.select(F.col("p_partkey").alias("rule_id"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "(").when(F.col("p_partkey") % 3 == 1, "[a-z]+"), "p_name").alias("pattern"))).select("rule_id"),
       "SELECT p_partkey::VARCHAR AS rule_id FROM part WHERE p_partkey % 3 <> 1")
_LETTERS = " || ".join(f"CASE WHEN n >= {sum(26**i for i in range(k + 1))} THEN chr((65 + (n - {sum(26**i for i in range(k + 1))}) // {26**k} % 26)::INT) ELSE '' END" for k in range(6, -1, -1))
simple("d01_exhibit_letters", lambda t: dedupe.numbered(t.files.select("path", "doc_id"), ["path", "doc_id"], "n").select("doc_id", c.letters(F.col("n")).alias("label")),
       FILES + f"SELECT doc_id, {_LETTERS} AS label FROM (SELECT doc_id, row_number() OVER (ORDER BY path, doc_id) AS n FROM files)")
simple("d02_exhibit_references", lambda t: t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0)))).alias("reference")).join(t.part.select(F.col("p_partkey").cast("string").alias("reference"), "p_name"), "reference", "left").select("doc_id", "reference", F.col("p_name").isNull().alias("missing")),
       "SELECT doc_id, reference, p_name IS NULL AS missing FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{4,}'))) AS reference FROM documents) LEFT JOIN (SELECT p_partkey::VARCHAR AS reference, p_name FROM part) USING (reference)")
simple("d03_required_blocks", lambda t: t.documents.select("doc_id", F.concat_ws(",", *(F.when(~F.col("text").rlike(p), F.lit(n)) for n, p in (("mark", "[.]"), ("the", r"\bthe\b"), ("line", "\n")))).alias("missing")),
       r"SELECT doc_id, concat_ws(',', CASE WHEN NOT regexp_matches(text, '[.]') THEN 'mark' END, CASE WHEN NOT regexp_matches(text, '\bthe\b') THEN 'the' END, CASE WHEN NOT contains(text, chr(10)) THEN 'line' END) AS missing FROM documents")
simple("d04_daily_matrix", lambda t: t.events.groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "purchase", "view"]).agg(F.count("event_id")).fillna(0),
       "SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
simple("d05_incidents", lambda t: rules.incidents(_hits(t).join(t.documents.select("doc_id", "source"), "doc_id"), "source", "doc_id"),
       f"SELECT source, rule_id, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents, {_RULES_SQL} WHERE regexp_matches(text, pattern) GROUP BY source, rule_id")


# Python batches and streams
simple("t02_secret_matches", lambda t: udfs.secret_matches(t.documents, "doc_id", "text").groupBy("doc_id", "rule").agg(F.count("*").alias("n")),
       "SELECT doc_id, rule, n FROM (SELECT doc_id, 'token' AS rule, len(regexp_extract_all(text, 'token = \"[0-9a-f]{40}\"')) AS n FROM documents UNION ALL SELECT doc_id, 'password', len(regexp_extract_all(text, 'password=[0-9a-z]+')) FROM documents UNION ALL SELECT doc_id, 'key', len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) FROM documents) WHERE n > 0")
_JSON = "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '' WHEN 2 THEN '[' || props || ']' WHEN 3 THEN props || chr(10) || props WHEN 4 THEN CAST(event_id AS VARCHAR(20)) ELSE '{' || props END"
simple("p22_json_sniff", lambda t: t.events.select("event_id", udfs.json_sniffer()(F.expr(_JSON)).alias("s")).select("event_id", "s.mode", F.array_join("s.keys", ",").alias("keys")),
       "SELECT event_id, (['object', 'empty', 'array', 'jsonl', 'scalar', 'unparseable'])[event_id % 6 + 1] AS mode, CASE WHEN event_id % 6 IN (0, 2, 3) THEN array_to_string(list_sort(json_keys(props)), ',') ELSE '' END AS keys FROM events")
query("p20_fuzzy_names")(lambda t: t.part.select("p_partkey", udfs.fuzzy("steel")("p_name").alias("ratio")))
simple("f02_embedding", lambda t: t.benchmark.select("item_id", F.posexplode(udfs.embedder(udfs.hashing_model)("text")).alias("place", "weight")).where("weight != 0").select("item_id", "place", F.round(F.col("weight").cast("double"), 4).alias("weight")),
       r"WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM benchmark), n AS (SELECT item_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 32)::INT AS place, count(*) AS n FROM w GROUP BY ALL) SELECT item_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 4) AS weight FROM n")
_CASE = "CASE event_id % 5 WHEN 0 THEN '{\"id\": 1, \"at\": \"' || event_type || '\", \"tags\": [\"a\"]}' WHEN 1 THEN '{\"at\": \"2024-01-01\", \"tags\": 3}' WHEN 2 THEN event_type WHEN 3 THEN '{\"id\": 2, \"tags\": []}' ELSE '{}' END"
simple("n05_validation", lambda t: t.events.select("event_id", F.array_join(payloads.issues(F.expr(_CASE), ["id"], ["at"], ["tags"]), ",").alias("issues")),
       "SELECT event_id, (['not a date at', 'missing id,not a list tags', 'not JSON', '', 'missing id'])[event_id % 5 + 1] AS issues FROM events")
simple("n11_snapshot_diff", lambda t: payloads.snapshot_diff(t.files.where("doc_id % 3 != 0").select("path", F.sha2("text", 256).alias("sha256")), t.files.where("doc_id % 5 != 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")), 256).alias("sha256"))),
       FILES + "SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM files WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 = 0) AND (doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0)")


def _streamed(t: Tables, name: str, build, mode: str = "append") -> DataFrame:
    import uuid

    table = getattr(t, name)
    base = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    stream = build(t.stream(name, table.schema))
    if mode == "append":
        jobs.drain(stream, f"{base}/out", f"{base}/state")
        return t.spark.read.parquet(f"{base}/out")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out")
    jobs._finished(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start())
    return t.spark.read.parquet(f"{base}/out")


simple("x04_first_wins_stream", lambda t: _streamed(t, "documents", lambda s: jobs.first_wins(s, "text").select("sha256")), "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
simple("x06_counters_stream", lambda t: _streamed(t, "events", lambda s: jobs.counters(s, "event_type"), "complete"), "SELECT event_type, count(*) AS count FROM events GROUP BY 1")


# Text by type, ledgers, manifests and names
simple("s14_text_by_type", lambda t: extract.extracted(t.files.withColumnRenamed("text", "body").withColumn("content", F.col("body").cast("binary")), "basename", "content", {k: v for k, v in extract.BY_TYPE.items() if k != ".docx"}).select("doc_id", "status", F.md5("text").alias("md5")),
       FILES + r"""SELECT doc_id, CASE WHEN t IS NULL THEN 'unsupported' WHEN trim(t) = '' THEN 'empty' ELSE 'done' END AS status, md5(t) AS md5 FROM (SELECT doc_id, CASE WHEN lower(ext) IN ('.txt', '.csv', '.json', '.py') THEN text WHEN ext = '.html' THEN trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) END AS t FROM files)""")
simple("k15_ledger_lines", lambda t: sinks.decoded_rows(t.labels.select("doc_id", F.format_string('["q%d", "t%d"]', "quality", "toxic").alias("tags")), {"tags": "array<string>"}),
       """SELECT '{"doc_id":' || doc_id || ',"tags":["q' || quality || '","t' || toxic || '"]}' AS line FROM labels""")
_MODULES = FILES + ", m AS (SELECT DISTINCT path, CASE WHEN doc_id % 3 <> 0 THEN lang END AS legal_function, CASE WHEN doc_id % 4 = 0 THEN ['/none'] ELSE [] END AS dependencies FROM files WHERE doc_id % 2 = 0)"


def _modules(t: Tables) -> DataFrame:
    needs = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("/none")))
    return t.files.where("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("legal_function"), needs.alias("dependencies")).distinct()


simple("n09_module_manifest", lambda t: payloads.module_manifest(_modules(t), t.files.where("doc_id % 5 != 0").select("path", F.sha2("text", 256).alias("sha256"))).withColumn("dependencies", F.array_join("dependencies", ",")),
       _MODULES + "SELECT m.path, sha256(f.text) AS sha256, legal_function, array_to_string(dependencies, ',') AS dependencies FROM m LEFT JOIN (SELECT * FROM files WHERE doc_id % 5 <> 0) f ON f.path = m.path")
simple("j07_manifest_faults", lambda t: payloads.manifest_faults(payloads.module_manifest(_modules(t), t.files.select("path", F.sha2("text", 256).alias("sha256"))), t.files.where("doc_id % 5 != 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")), 256).alias("sha256"))),
       _MODULES + """, g AS (SELECT m.*, f.doc_id, f.text FROM m JOIN files f ON f.path = m.path) SELECT path, unnest(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'missing' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 AND text <> '' THEN 'changed' END, CASE WHEN legal_function IS NULL THEN 'no function' END, CASE WHEN len(dependencies) > 0 THEN 'needs /none' END], lambda x: x IS NOT NULL)) AS fault FROM g""")
simple("n10_listing_manifest", lambda t: dedupe.numbered(t.files.select("path", "bytes"), ["path", "bytes"], "n"), FILES + "SELECT path, bytes, row_number() OVER (ORDER BY path, bytes) AS n FROM files")
def _taken(t: Tables) -> DataFrame:
    """Names that are there: of every third type the plain one, of every fifth the one with a 2."""
    kinds = t.part.select(F.col("p_brand").alias("folder"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("kind"), F.length("p_type").alias("n")).distinct()
    return kinds.where("n % 3 = 0").select("folder", F.concat("kind", F.lit(".pdf")).alias("name")).unionByName(kinds.where("n % 5 = 0").select("folder", F.concat("kind", F.lit(" (2).pdf")).alias("name")))


simple("w04_free_names", lambda t: plans.free_names(t.part.select("p_partkey", F.col("p_brand").alias("folder"), F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".pdf")).alias("name")), _taken(t), ["p_partkey"]).select("p_partkey", "final"),
       """WITH m AS (SELECT p_partkey, replace(p_type, ' ', '_') AS name, length(p_type) AS l, p_brand, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand, p_type) AS c FROM part),
       b AS (SELECT *, (i = 0 AND l % 3 = 0) OR (i = 2 AND l % 5 = 0) AS bad FROM m), r AS (SELECT *, c - 1 + row_number() OVER (PARTITION BY p_brand, name, bad ORDER BY p_partkey) AS later FROM b),
       n AS (SELECT p_partkey, name, CASE WHEN NOT bad THEN i WHEN later = 2 AND l % 5 = 0 THEN 3 ELSE later END AS n FROM r)
       SELECT p_partkey, CASE WHEN n = 0 THEN name || '.pdf' ELSE name || ' (' || n || ').pdf' END AS final FROM n""")


def _passes(t: Tables) -> DataFrame:
    """The ids of a table, catalogued in passes of one batch each until nothing is left."""
    import uuid

    base = f"{shared_dir(t.spark)}/passes-{uuid.uuid4().hex}"
    keep = lambda batch, n: batch.select("event_id").write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    while jobs.daemon_step(t.stream("events", t.events.schema, 4), keep, f"{base}/state", f"{base}/ledger"):
        pass
    return t.spark.read.parquet(f"{base}/out").select("event_id")


simple("x02_budgeted_passes", _passes, "SELECT event_id FROM events")
