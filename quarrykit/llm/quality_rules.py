"""Quality rules with adaptive thresholds.

Fixed rules come first. Further measures are held against fences that follow
from quantiles per language and source. The quantiles are read from histograms
with buckets of bounded relative width; such sketches merge by adding counts,
so languages and the whole corpus reuse the sketches of their sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan
from quarrykit.llm.store import written

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)

#: Documents that a sketch needs before its own fence holds; smaller groups use their language, then the corpus.
LEAST = 100
#: Measures in thousandths (of a word, or of a character) and the least spread that a fence allows for.
MEASURES = {"symbols": 50, "uppercase": 50, "word_length": 1000, "repeated_lines": 20}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")


def _repeated_window_words(words: scan.Words, rows: int, width: int) -> np.ndarray:
    """Of each row the words that lie in a window of ``width`` words found at least twice in the row."""
    windows, first = scan.shingles_of(words, width)
    row = np.repeat(np.arange(rows), np.diff(first))
    key = scan.mixed(windows ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(key.size, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    begin = (words.first[:-1] - first[:-1])[row] + np.arange(key.size)
    marks = np.zeros(words.hash.size + width + 1, np.int64)
    np.add.at(marks, begin[twice], 1)
    np.add.at(marks, begin[twice] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[: words.hash.size]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def _repeated_lines(buf: np.ndarray, offsets: np.ndarray, words: scan.Words, rows: int) -> np.ndarray:
    lines = scan.words_of(buf, offsets, scan.LINES, False)
    full = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    h, row = lines.hash[full], lines.row[full]
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=rows)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in scan.slices(batch, "text"):
            buf, offsets = scan.buffer_of(part.column("text"))
            words = scan.words_of(buf, offsets, scan.SPACED, False)

            def total(kind: np.ndarray, offsets=offsets) -> np.ndarray:
                upto = np.concatenate([[0], np.cumsum(kind, dtype=np.int64)])
                return upto[offsets[1:]] - upto[offsets[:-1]]

            n = part.num_rows
            counts = [
                np.diff(words.first), total(scan.SPACED[buf] & ((buf & 0xC0) != 0x80)), total(_SYMBOL[buf]),
                _repeated_lines(buf, offsets, words, n), _repeated_window_words(words, n, 5), total(_UPPER[buf]),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "lang", "source", *BASE]
            )


def _bucket(v: Column) -> Column:
    """The least value of v's bucket: v cut to its six leading binary digits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, fence, n): three spreads above the upper quartile of each merged sketch."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    place = ", ".join([*keys, "measure"])
    ranked = merged.selectExpr("*", f"sum(n) OVER (PARTITION BY {place} ORDER BY bucket) AS upto", f"sum(n) OVER (PARTITION BY {place}) AS total")
    quartiles = ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(F.expr("4 * upto >= total"), F.col("bucket"))).alias("low"),
        F.min(F.when(F.expr("4 * upto >= 3 * total"), F.col("bucket"))).alias("high"),
        F.max("total").alias("n"),
    )
    spread = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))[F.col("measure")].cast("long")
    return quartiles.select(*keys, "measure", (F.col("high") + 3 * F.greatest(F.col("high") - F.col("low"), spread)).alias("fence"), "n")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdicts for every row of docs(doc_id, text, lang, source).

    base_failed: fewer than 10 words, or over 20 % of the words in 5-word windows
    that occur twice. kept: not base_failed, and no measure (symbols a word,
    upper-case letters a character, characters a word, repeated lines a word)
    above the fence of the document's language and source.

    Null or blank text has no words and fails. A null language or source is a
    group of its own, as is an empty one with it. Null doc_ids and repeated rows
    are kept as rows; other columns are ignored; an empty table gives no rows.
    """
    base = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    counted = base.mapInArrow(_measured, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in BASE))
    counted = counted.selectExpr(
        "*",
        "1000 * n_symbols DIV greatest(n_words, 1) AS symbols",
        "1000 * n_upper DIV greatest(word_chars, 1) AS uppercase",
        "1000 * word_chars DIV greatest(n_words, 1) AS word_length",
        "1000 * n_dup_lines DIV greatest(n_words, 1) AS repeated_lines",
        "n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed",
    )
    counted = written(counted, "measures")
    long = counted.where("n_words > 0").unpivot(["lang", "source"], list(MEASURES), "measure", "value")
    sketch = long.groupBy("lang", "source", "measure", _bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
    sketch = written(sketch, "sketch")
    levels = [_fences(sketch, keys) for keys in (["lang", "source"], ["lang"], [])]
    groups = sketch.select("lang", "source", "measure").distinct()
    chosen = groups
    for i, (level, keys) in enumerate(zip(levels, (["lang", "source", "measure"], ["lang", "measure"], ["measure"]), strict=True)):
        chosen = chosen.join(level.withColumnsRenamed({"fence": f"fence{i}", "n": f"n{i}"}), keys, "left")
    chosen = chosen.select(
        "lang", "source", "measure", F.when(F.col("n0") >= LEAST, F.col("fence0")).when(F.col("n1") >= LEAST, F.col("fence1")).otherwise(F.col("fence2")).alias("fence")
    )
    wide = chosen.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in MEASURES))
    judged = counted.join(wide, ["lang", "source"], "left")
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(m) <= F.col(f"max_{m}"))
    return judged.withColumn("kept", F.coalesce(~F.col("base_failed") & within, F.lit(False))).select(
        "doc_id", *BASE[:-1], "base_failed", "kept", *BASE[-1:], *MEASURES, *(f"max_{m}" for m in MEASURES)
    )


_LEVEL = "SELECT {keys} measure, high + 3 * greatest(high - low, CASE measure {spreads} END) AS fence, n FROM (SELECT {keys} measure, min(CASE WHEN 4 * upto >= total THEN bucket END) AS low, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS high, max(total) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS total FROM (SELECT {keys} measure, bucket, sum(n) AS n FROM sketch GROUP BY {keys} measure, bucket)) GROUP BY {keys} measure)"


def rules_sql() -> str:
    spreads = " ".join(f"WHEN '{m}' THEN {s}" for m, s in MEASURES.items())
    levels = [_LEVEL.format(keys=k, spreads=spreads) for k in ("lang, source, ", "lang, ", "")]
    maxima = ", ".join(f"max(CASE WHEN measure = '{m}' THEN fence END) AS max_{m}" for m in MEASURES)
    within = " AND ".join(f"{m} <= max_{m}" for m in MEASURES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
      FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, n, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS gram
      FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g WHERE i <= n - 4) WHERE c > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, i + o AS i FROM twice, range(0, 5) AS t(o)) GROUP BY r),
wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
         FROM d LEFT JOIN wc USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
counted AS (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_upper // greatest(word_chars, 1) AS uppercase,
              1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_dup_lines // greatest(n_words, 1) AS repeated_lines,
              n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
long AS (SELECT lang, source, unnest({list(MEASURES)}) AS measure, unnest([{", ".join(MEASURES)}]) AS v FROM counted WHERE n_words > 0),
sketch AS (SELECT lang, source, measure, (v >> s) << s AS bucket, count(*) AS n
           FROM (SELECT *, greatest(0, length(bin(v)) - 6) AS s FROM long) GROUP BY ALL),
l0 AS ({levels[0]}), l1 AS ({levels[1]}), l2 AS ({levels[2]}),
chosen AS (SELECT l0.lang, l0.source, measure, CASE WHEN l0.n >= {LEAST} THEN l0.fence WHEN l1.n >= {LEAST} THEN l1.fence ELSE l2.fence END AS fence
           FROM l0 JOIN l1 USING (lang, measure) JOIN l2 USING (measure)),
wide AS (SELECT lang, source, {maxima} FROM chosen GROUP BY lang, source)
SELECT doc_id, {", ".join(BASE[:-1])}, base_failed, coalesce(NOT base_failed AND {within}, false) AS kept, n_upper, {", ".join(MEASURES)},
  {", ".join(f"max_{m}::BIGINT AS max_{m}" for m in MEASURES)}
FROM counted LEFT JOIN wide USING (lang, source)"""
