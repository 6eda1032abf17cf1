"""Queries over single rows: sources, column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import columns as c
from quarrykit.operators import dedupe, search
from quarrykit.plans.registry import BUCKET, EXT, FILES, Tables, query, simple
from quarrykit.sources import files as src


def _extension() -> Column:
    return c.extension(F.col("basename"))


def _bucket() -> Column:
    return c.bucket(_extension())



@query("dedupe_summary", FILES + f"""SELECT bucket, count(*) AS files, count(DISTINCT h) AS unique_texts, sum(first) AS canonical, sum(bytes)::BIGINT AS total_bytes
  FROM (SELECT {BUCKET} AS bucket, sha256(text) AS h, bytes, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY path, doc_id) = 1 THEN 1 ELSE 0 END AS first FROM files) GROUP BY bucket""")
def _(t: Tables) -> DataFrame:
    hashed = t.files.select("doc_id", "path", "bytes", F.sha2("text", 256).alias("h"), _bucket().alias("bucket"))
    picked = dedupe.with_canonical(hashed, ["h"], ["path", "doc_id"], "doc_id")
    return picked.groupBy("bucket").agg(
        F.count("*").alias("files"), F.count_distinct("h").alias("unique_texts"), F.count_if(F.col("doc_id") == F.col("canonical_doc_id")).alias("canonical"), F.sum("bytes").alias("total_bytes")
    )


# Sources
simple("s03_folder_exclusion", lambda t: src.excluding_folders(t.files, ["src3", "fr"], "/d120/").select("doc_id", "path"),
       FILES + "SELECT doc_id, path FROM files WHERE NOT list_has_any(string_split(path, '/'), ['src3', 'fr']) AND NOT regexp_matches(path, '/d120/')")
simple("s04_hidden_exclusion", lambda t: src.visible(t.files.withColumn("path", F.when(F.col("doc_id") % 5 == 0, F.replace("path", F.lit("/d"), F.lit("/.d"))).otherwise(F.col("path")))).select("doc_id", "path"),
       FILES + "SELECT doc_id, path FROM files WHERE doc_id % 5 <> 0")
simple("s05_screen", lambda t: src.screened(t.files, r"(?i)\.(txt|csv|py|html)$", 4000).groupBy("accepted").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")),
       FILES + r"SELECT regexp_matches(basename, '(?i)\.(txt|csv|py|html)$') AND bytes <= 4000 AS accepted, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM files GROUP BY 1")
def _marked() -> Column:
    return F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("~$"), "basename")).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("__DONE__"), "basename")).otherwise(F.col("basename"))


simple("s06_lock_exclusion", lambda t: src.unlocked(t.files.withColumn("basename", _marked())).select("doc_id", "basename"), FILES + "SELECT doc_id, basename FROM files WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
simple("s15_page_links", lambda t: src.page_links(t.pages, "^/", "[A-Z][a-z]{2,}"),
       """WITH a AS (SELECT page_id, url, unnest(x) AS anchor, generate_subscripts(x, 1) - 1 AS position FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>') AS x FROM pages)),
       b AS (SELECT *, regexp_extract(anchor, '<a href="([^"]*)">', 1) AS href, regexp_extract(anchor, '>([^<]*)</a>', 1) AS label FROM a),
       d AS (SELECT *, replace(coalesce(nullif(regexp_extract(label, '[A-Z][a-z]{2,}'), ''), nullif(regexp_extract(href, '[A-Z][a-z]{2,}'), '')), ' ', '-') AS form_id FROM b WHERE regexp_matches(href, '^/'))
       SELECT page_id, position, form_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href AS address FROM d WHERE form_id IS NOT NULL""")
simple("s16_prefix_and_substring", lambda t: src.matching(t.events, ("event_type", "c"), "9").select("event_id", "event_type", "user_id"),
       "SELECT event_id, event_type, user_id FROM events WHERE event_type LIKE 'c%' AND (contains(event_id::VARCHAR, '9') OR contains(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '9') OR contains(user_id::VARCHAR, '9') OR contains(value::VARCHAR, '9') OR contains(props, '9'))")

# Column functions
simple("p01_extension", lambda t: t.files.select("doc_id", _extension().alias("extension"), c.extension(F.col("basename"), True).alias("dotted")),
       FILES + rf"SELECT doc_id, {EXT} AS extension, lower(regexp_extract(basename, '(\.[^.]*)$', 1)) AS dotted FROM files")
simple("p02_path_parts", lambda t: t.files.select("doc_id", c.basename(F.col("path")).alias("name"), c.stem(F.col("basename")).alias("stem"), c.relative(F.col("path"), F.col("root")).alias("relative")),
       FILES + r"SELECT doc_id, string_split(path, '/')[-1] AS name, regexp_replace(basename, '([^.])\.[^.]+$', '\1') AS stem, substr(path, length(root) + 3) AS relative FROM files")
simple("p03_bucket", lambda t: t.files.select("doc_id", _bucket().alias("bucket")), FILES + f"SELECT doc_id, {BUCKET} AS bucket FROM files")
simple("p04_mime_before_extension", lambda t: t.files.select("doc_id", F.coalesce(F.when(F.col("lang") == "fr", "Images").when(F.col("lang") == "de", "Music"), _bucket()).alias("bucket")),
       FILES + f"SELECT doc_id, CASE lang WHEN 'fr' THEN 'Images' WHEN 'de' THEN 'Music' ELSE {BUCKET} END AS bucket FROM files")
simple("p05_placement_flags", lambda t: t.files.select("doc_id", (F.col("ext") == ".zip").alias("is_shortcut"), F.arrays_overlap(F.split("path", "/"), F.array(F.lit("src1"), F.lit("src2"))).alias("in_buckets")),
       FILES + "SELECT doc_id, ext = '.zip' AS is_shortcut, list_has_any(string_split(path, '/'), ['src1', 'src2']) AS in_buckets FROM files")
simple("p06_preview", lambda t: t.documents.select("doc_id", c.preview(F.col("text"), 80).alias("preview"), c.preview(F.col("text"), 60, True).alias("excerpt")),
       r"SELECT doc_id, left(regexp_replace(text, '\s+', ' ', 'g'), 80) AS preview, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 60) AS excerpt FROM documents")
simple("p07_first_filled", lambda t: t.documents.select("doc_id", c.first_filled([F.when(F.col("doc_id") % 3 == 0, ""), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("text")], 1000).alias("preview")),
       "SELECT doc_id, left(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN source END, ''), nullif(text, ''), ''), 1000) AS preview FROM documents")
simple("p08_digests", lambda t: t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5")), "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
simple("p09_object_hash", lambda t: t.documents.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source")), 256).alias("object_hash")),
       """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS object_hash FROM documents""")
simple("p10_quick_signature", lambda t: t.documents.select("doc_id", F.inline(F.array(c.quick_signature(F.encode("text", "UTF-8"))))).drop("tail_sha1"),
       "SELECT doc_id, strlen(text)::BIGINT AS size, sha1(encode(text)[1:65536]) AS head_sha1 FROM documents")
simple("p11_stable_id", lambda t: t.files.select("doc_id", c.stable_id(F.col("root"), F.col("path"), F.col("bytes").cast("string")).alias("id")),
       FILES + "SELECT doc_id, 'Q:' || substr(sha256(concat_ws('|', root, path, bytes::VARCHAR)), 1, 20) AS id FROM files")
def _md5() -> Column:
    return F.when(F.col("doc_id") % 2 == 0, F.md5("text")).otherwise("")


simple("p12_dedupe_key", lambda t: t.files.select("doc_id", c.dedupe_key(_md5(), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("basename")), F.col("bytes"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("ext"))).alias("key")),
       FILES + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'md5:' || md5(text) WHEN doc_id % 3 = 0 THEN NULL ELSE 'nss:' || concat_ws('|', basename, bytes::VARCHAR, ext) END AS key FROM files")
simple("p13_newlines", lambda t: t.documents.select("doc_id", F.md5(c.unix_newlines(F.replace("text", F.lit("\n"), F.lit("\r\n")))).alias("md5")), "SELECT doc_id, md5(text) AS md5 FROM documents")
simple("p14_safe_names", lambda t: t.files.select("doc_id", c.safe_name(F.col("path")).alias("file_name"), c.safe_name(F.col("lang"), "A-Za-z0-9_-", 48, "token").alias("token")),
       FILES + "SELECT doc_id, left(regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g'), 120) AS file_name, left(regexp_replace(lang, '[^A-Za-z0-9_-]', '_', 'g'), 48) AS token FROM files")
simple("p15_human_size", lambda t: t.files.select("doc_id", c.human_size(F.col("bytes") * 977).alias("size")),
       FILES + "SELECT doc_id, CASE WHEN bytes * 977 < 1024 THEN printf('%.2f B', bytes * 977.0) WHEN bytes * 977 < 1048576 THEN printf('%.2f KB', bytes * 977 / 1024.0) WHEN bytes * 977 < 1073741824 THEN printf('%.2f MB', bytes * 977 / 1048576.0) ELSE printf('%.2f GB', bytes * 977 / 1073741824.0) END AS size FROM files")
simple("p16_space_estimate", lambda t: t.files.agg(F.sum("bytes").alias("total")).select("total", (F.col("total") + F.floor(F.col("total") * 12 / 10) + 200 * 1024 * 1024).alias("needed")),
       FILES + "SELECT sum(bytes)::BIGINT AS total, (sum(bytes) + sum(bytes) * 12 // 10 + 209715200)::BIGINT AS needed FROM files")
simple("p17_iso_time", lambda t: t.events.select("event_id", c.iso_utc(F.col("ts")).alias("iso")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
simple("p18_token_estimate", lambda t: t.documents.select("doc_id", c.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
simple("p19_occurrences", lambda t: t.documents.select("doc_id", c.occurrences(F.col("text"), "th").alias("n")), "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'th', ''))) // 2)::BIGINT AS n FROM documents")
simple("p23_html_sniff", lambda t: t.pages.select("page_id", c.html_title(F.col("html")).alias("title"), F.array_join(c.hints(F.col("html"), ["track(", "class=\"ad\"", "jquery", "<nav>"]), ",").alias("hints")),
       r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, array_to_string(list_filter(['track(', 'class="ad"', 'jquery', '<nav>'], lambda h: contains(lower(html), h)), ',') AS hints FROM pages""")
simple("p24_description", lambda t: t.files.select("doc_id", F.when(_extension() == ".csv", F.format_string("CSV of %d bytes", "bytes")).when(_extension() == ".json", F.format_string("JSON in %s", "lang")).otherwise(F.concat(F.lit("File "), "basename")).alias("description")),
       FILES + f"SELECT doc_id, CASE WHEN {EXT} = '.csv' THEN 'CSV of ' || bytes || ' bytes' WHEN {EXT} = '.json' THEN 'JSON in ' || lang ELSE 'File ' || basename END AS description FROM files")
simple("p25_relevance", lambda t: t.documents.select("doc_id", c.relevance(F.col("doc_id") % 2, F.col("doc_id") % 5, F.col("doc_id") % 3).alias("score")).withColumn("keep", F.col("score") >= 0.5),
       "SELECT *, score >= 0.5 AS keep FROM (SELECT doc_id, (CASE WHEN doc_id % 2 > 0 THEN 1.0 ELSE 0.0 END + least(doc_id % 5, 3) * 0.5 + least(doc_id % 3, 3) * 0.5)::DOUBLE AS score FROM documents)")
simple("p26_like_search", lambda t: t.documents.where(F.lower("text").contains("license") | F.lower("source").contains("src7")).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src7')")
def _words() -> Column:
    return F.split(F.lower("text"), " ")


simple("p27_reference_lookup", lambda t: t.benchmark.where(F.exists(_words(), lambda x: x.contains("onth"))).select("item_id"), "SELECT item_id FROM benchmark WHERE len(list_filter(string_split(lower(text), ' '), lambda x: contains(x, 'onth'))) > 0")
simple("p28_point_lookup", lambda t: t.documents.where("doc_id = 42").select("doc_id", F.size(F.split("text", "\n")).alias("lines")), "SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines FROM documents WHERE doc_id = 42")
simple("p29_text_rules", lambda t: t.documents.select("doc_id", F.when(F.col("text").rlike("(?i)token|password"), "banned").when(~F.col("text").rlike("^[A-Z]"), "prefix").otherwise("").alias("reason")).withColumn("valid", F.col("reason") == ""),
       "SELECT *, reason = '' AS valid FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)token|password') THEN 'banned' WHEN NOT regexp_matches(text, '^[A-Z]') THEN 'prefix' ELSE '' END AS reason FROM documents)")
simple("p30_layer_norm", lambda t: t.embeddings.select("vec_id", F.posexplode(c.layer_norm(F.col("embedding").cast("array<double>"))).alias("i", "x")).groupBy("vec_id").agg(F.round(F.sum(F.abs("x")), 5).alias("l1")),
       "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, avg(v) AS mean, var_pop(v) AS var FROM e GROUP BY vec_id) SELECT vec_id, round(sum(abs((v - mean) / sqrt(var + 1e-5))), 5) AS l1 FROM e JOIN m USING (vec_id) GROUP BY vec_id")
simple("p31_masked_softmax", lambda t: search.masked_softmax(t.events.select("event_id", "user_id", "value", (F.col("event_id") % 3 != 0).alias("mask")), "user_id", "value", "mask").select("event_id", F.round("weight", 6).alias("weight")),
       "WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN exp(value - max(CASE WHEN event_id % 3 <> 0 THEN value END) OVER (PARTITION BY user_id)) END AS x FROM events) SELECT event_id, CASE WHEN sum(x) OVER (PARTITION BY user_id) IS NOT NULL THEN round(coalesce(x, 0) / sum(x) OVER (PARTITION BY user_id), 6) END AS weight FROM e")
simple("p32_needs_ocr", lambda t: t.files.select("doc_id", ((_extension() == ".pdf") & (F.trim(F.coalesce(F.when(F.col("doc_id") % 24 != 0, F.col("text")), F.lit(""))) == "")).alias("needs_ocr")),
       FILES + f"SELECT doc_id, {EXT} = '.pdf' AND trim(coalesce(CASE WHEN doc_id % 24 <> 0 THEN text END, '')) = '' AS needs_ocr FROM files")
