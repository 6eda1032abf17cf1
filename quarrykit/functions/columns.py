"""Column functions: names, hashes, previews, sizes, checks. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets by extension, fixed values; what isn't listed is Other.
BUCKETS = {
    "Documents": [".pdf", ".docx", ".doc", ".txt", ".rtf", ".odt"],
    "Spreadsheets": [".csv", ".xlsx", ".xls"],
    "Images": [".jpg", ".jpeg", ".png", ".gif"],
    "Music": [".mp3", ".wav"],
    "Archives": [".zip", ".gz", ".tar", ".7z"],
    "Code": [".py", ".js", ".html", ".json"],
}


def extension(name: Column, leading_dot: bool = False) -> Column:
    """From the last dot, in lower case; a name that only starts with a dot has one if ``leading_dot``."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$" if leading_dot else r"[^.](\.[^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"([^.])\.[^.]+$", "$1")


def relative(path: Column, root: Column) -> Column:
    start = F.concat(F.lit("/"), root, F.lit("/"))
    return F.when(path.startswith(start), F.substring(path, F.length(start) + 1, F.length(path))).otherwise(path)


def bucket(ext: Column) -> Column:
    return reduce(lambda w, b: w.when(ext.isin(BUCKETS[b]), b), BUCKETS, F).otherwise("Other")


def preview(text: Column, n: int, trim: bool = False) -> Column:
    """White space collapsed, cut to n characters; trimmed first if asked for."""
    flat = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.left(F.trim(flat) if trim else flat, F.lit(n))


def first_filled(columns: Sequence[Column], n: int) -> Column:
    return F.left(F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit("")), F.lit(n))


def quick_signature(content: Column, edge: int = 65536) -> Column:
    """(size, sha1 of the head, sha1 of the tail); the tail is empty up to one edge of bytes."""
    size = F.octet_length(content)
    tail = F.when(size > edge, F.substring(content, F.greatest(size - edge + 1, F.lit(edge + 1)), F.lit(edge))).otherwise(F.lit(b""))
    return F.struct(size.cast("long").alias("size"), F.sha1(F.substring(content, 1, edge)).alias("head_sha1"), F.sha1(tail).alias("tail_sha1"))


def stable_id(*parts: Column) -> Column:
    return F.concat(F.lit("Q:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def dedupe_key(md5: Column, name: Column, size: Column, mime: Column) -> Column:
    named = F.concat(F.lit("nss:"), F.concat_ws("|", name, size.cast("string"), mime))
    return F.when(md5 != "", F.concat(F.lit("md5:"), md5)).when((name == "") & (mime == ""), F.lit(None)).otherwise(named)


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def safe_name(name: Column, allowed: str = "A-Za-z0-9._-", n: int = 120, default: str | None = None) -> Column:
    cleaned = F.left(F.regexp_replace(name, f"[^{allowed}]", "_"), F.lit(n))
    return cleaned if default is None else F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def human_size(size: Column) -> Column:
    """Two decimals in steps of 1024; an exact half goes to the even digit."""
    units = ["B", "KB", "MB", "GB", "TB"]
    two = lambda i: F.format_string(f"%.2f {units[i]}", F.bround(size / float(1024**i), 2))
    found = two(4)
    for i in range(3, -1, -1):
        found = F.when(size < 1024 ** (i + 1), two(i)).otherwise(found)
    return found


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def occurrences(text: Column, needle: str) -> Column:
    """Occurrences that don't overlap, whatever the case."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1), r"\s+", " "))


def hints(text: Column, words: Sequence[str]) -> Column:
    """Those of the words, in their order, that the text holds."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.contains(w), F.lit(w)) for w in words)))


def relevance(claims: Column, statutes: Column, rules: Column) -> Column:
    return F.when(claims > 0, 1.0).otherwise(0.0) + F.least(statutes, F.lit(3)) * 0.5 + F.least(rules, F.lit(3)) * 0.5


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row: a lambda's argument isn't copied into its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def layer_norm(x: Column, eps: float = 1e-5, weight: float = 1.0, bias: float = 0.0) -> Column:
    """(x - mean) / sqrt(population variance + eps) * weight + bias of an array."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, e: a + e) / F.size(v)
    centred = _let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    scaled = lambda c: _let(F.sqrt(mean(F.transform(c, lambda v: v * v)) + eps), lambda s: F.transform(c, lambda v: v / s * weight + bias))
    return _let(centred, scaled)


def chunks(text: Column, size: int = 600, stride: int = 520) -> Column:
    """Overlapping windows of words; a text without words has none."""

    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))

    return _let(F.array_remove(F.split(text, r"[ \t\n\r\f]+"), ""), cut)


def letters(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA, 703 is AAA and so on."""
    parts = []
    for place in range(12, -1, -1):
        least = sum(26**i for i in range(place + 1))
        digit = F.floor((n - F.lit(least)) / F.lit(26**place)) if place else n - 1
        parts.append(F.when(n >= least, F.char(F.lit(65) + digit % 26)).otherwise(""))
    return F.concat(*parts)


def terms_of(text: Column) -> Column:
    """The terms of a text in order: runs of two or more of a-z and 0-9, lower-cased; a null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
