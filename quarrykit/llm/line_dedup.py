"""Line dedup: repeated runs of lines go, found by winnowing over line hashes.

Grams are runs of GRAM lines. Of every WINDOW neighbouring grams the least hash
is a fingerprint, so each repeated run of GRAM + WINDOW - 1 lines holds one at
the same place in all its copies. A fingerprint joins its earliest position;
the match is extended both ways, by the line beside it if gram and line occur
earlier together, whichever copy that is; a longer match holds the next
fingerprint. Where short runs count too, each line that the runs leave is then
compared with all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.store import computed, written

GRAM = 2
WINDOW = 2


def _number(text: Column) -> Column:
    """60 bits of the MD5 digest as a number, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """The positions of the lines that hold more than blanks."""
    return F.filter(F.transform(lines, lambda line, i: F.when(F.trim(line) != "", i)), lambda i: i.isNotNull())


_PLACE = ("doc_id", "key", "at")


def _key() -> Column:
    """Tells texts of one doc_id apart."""
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _fingerprints(docs: DataFrame) -> DataFrame:
    """(gram, doc_id, key, at, before, after): the winnowed grams, with the hash of the next line on each side."""
    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", _key().alias("key"), _lines(F.col("text")).alias("lines"))
    filled = F.filter("lines", lambda x: F.trim(x) != "")
    hashed = computed(hashed, "h", F.transform(filled, F.md5)).drop("lines").where(F.size("h") >= GRAM)
    gram = lambda i: _number(F.concat(*(F.get("h", i + j) for j in range(GRAM))))
    grams = computed(hashed, "g", F.transform(F.sequence(F.lit(0), F.size("h") - GRAM), gram))
    # With two grams a window, a gram is chosen if it is less than the next one, or not more than the one before.
    left, right = F.get("g", F.col("at") - 1), F.get("g", F.col("at") + 1)
    rows = grams.select("doc_id", "key", "h", "g", F.posexplode("g").alias("at", "gram"))
    chosen = rows.where(F.coalesce(F.col("gram") < right, F.lit(False)) | F.coalesce(F.col("gram") <= left, F.lit(False)) | (F.size("g") == 1))
    return chosen.select("gram", *_PLACE, F.get("h", F.col("at") - 1).alias("before"), F.get("h", F.col("at") + GRAM).alias("after"))


def _first(found: DataFrame, *by: str) -> DataFrame:
    """(by..., first), written, so that a join with it can be split where a key is hot: the earliest place of what has more than one."""
    place = F.struct(*_PLACE)
    first = found.dropna(subset=list(by)).groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("other"))
    return written(first.where("first != other").drop("other"), "first")


def _winnowed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, from, to): the runs that go, by fingerprints and the lines beside them."""
    found = written(_fingerprints(docs), "fingerprints")
    again = found.join(_first(found, "gram"), "gram").where(F.struct(*_PLACE) != F.col("first")).drop("first")
    for side in ("before", "after"):
        first = _first(found, "gram", side).withColumnRenamed("first", "__first")
        also = F.coalesce(F.struct(*_PLACE) != F.col("__first"), F.lit(False))
        again = again.join(first, ["gram", side], "left").withColumn(f"__{side}", also.cast("int")).drop("__first")
    return again.select("doc_id", "key", (F.col("at") - F.col("__before")).alias("from"), (F.col("at") + GRAM - 1 + F.col("__after")).alias("to"))


def _single(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, key, from, to): of the lines that aren't among gone(doc_id, key, at), each that occurs earlier, as a run of one."""
    filled = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", _key().alias("key"), F.posexplode(F.transform(filled, _number)).alias("at", "gram"))
    found = written(rows, "lines")
    left = found.join(gone, [*_PLACE], "left_anti")
    again = left.join(_first(found, "gram"), "gram").where(F.struct(*_PLACE) != F.col("first"))
    return again.select("doc_id", "key", F.col("at").alias("from"), F.col("at").alias("to"))


def line_dedup(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs without later copies of repeated runs of lines, with n_lines and n_removed.

    Every run of GRAM lines that is a fingerprint and occurs earlier (by doc_id,
    then position) goes, with the lines beside it that occur earlier beside it.
    So a repeated run of GRAM + WINDOW - 1 lines or more goes whole; each line
    that goes has an equal one earlier that stays. Blank lines
    aren't counted, are looked through, and stay. With ``short`` runs of any
    length count, so every line with an equal one earlier goes, also a line that
    repeats alone and the lines of texts with fewer than GRAM.

    Null text counts as no lines and stays null; a null doc_id is never matched.
    Rows with the same doc_id and text are one document; texts of one doc_id that
    differ are apart, in an order of their own. Columns of docs pass through, but
    for n_lines and n_removed, which are replaced; an empty table gives no rows.
    """
    runs = _winnowed(docs)
    if short:
        runs = written(runs, "runs")
        places = runs.select("doc_id", "key", F.explode(F.sequence("from", "to")).alias("at")).distinct()
        runs = runs.unionByName(_single(docs, places))
    gone = runs.select("doc_id", "key", F.explode(F.sequence("from", "to")).alias("line")).groupBy("doc_id", "key").agg(F.collect_set("line").alias("__gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__doc_id", "key": "__key"})
    lines = _lines(F.col("text"))
    docs = docs.drop("n_lines", "n_removed")
    out = docs.join(gone, (F.col("doc_id") == F.col("__doc_id")) & (_key() == F.col("__key")), "left").drop("__doc_id", "__key")
    out = computed(computed(out, "__lines", lines), "__filled", _filled(F.col("__lines")))
    out = out.withColumn("n_lines", F.size("__filled").cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    dropped = F.transform("__gone", lambda i: F.get("__filled", i))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), dropped)
    left = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    return out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)).withColumn(
        "n_removed", F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")
    ).drop("__gone", "__filled", "__lines")


LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
n AS (SELECT doc_id, line, pos, md5(line) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS spot FROM l WHERE trim(line) <> ''),
g0 AS (SELECT doc_id, spot, pos, lag(h) OVER p AS before, lead(h, {GRAM}) OVER p AS after, lead(h, {GRAM - 1}) OVER p AS final,
         ('0x' || substr(md5(h || {" || ".join(f"lead(h, {i}) OVER p" for i in range(1, GRAM))}), 1, 15))::BIGINT AS gram FROM n WINDOW p AS (PARTITION BY doc_id ORDER BY spot)),
g AS (SELECT *, lag(gram) OVER p AS l, lead(gram) OVER p AS r FROM g0 WHERE final IS NOT NULL WINDOW p AS (PARTITION BY doc_id ORDER BY spot)),
f AS (SELECT * FROM g WHERE coalesce(gram < r, false) OR coalesce(gram <= l, false) OR (l IS NULL AND r IS NULL)),
m AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id, spot) AS k, row_number() OVER (PARTITION BY gram, before ORDER BY doc_id, spot) AS kb,
        row_number() OVER (PARTITION BY gram, after ORDER BY doc_id, spot) AS ka FROM f),
gone AS (SELECT DISTINCT doc_id, unnest(range(spot - CASE WHEN before IS NOT NULL AND kb > 1 THEN 1 ELSE 0 END, spot + {GRAM} + CASE WHEN after IS NOT NULL AND ka > 1 THEN 1 ELSE 0 END)) AS spot FROM m WHERE k > 1),
lost AS (SELECT doc_id, pos FROM n JOIN gone USING (doc_id, spot)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN lost USING (doc_id, pos) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id), x AS (SELECT doc_id, count(*) AS n_removed FROM lost GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""
