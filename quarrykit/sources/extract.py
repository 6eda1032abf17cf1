"""Text of files by their type: one function of their bytes for each extension."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.udfs import extractor
from quarrykit.sources.files import decoded

#: Bytes of a text file that are read at most.
LIMIT = 1 << 24


def plain(content: Column) -> Column:
    return decoded(content, LIMIT)


def page(content: Column) -> Column:
    """The text of a page, its markup, scripts and styles taken out."""
    hidden = F.regexp_replace(plain(content), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(hidden, r"<[^>]*>", " "), r"\s+", " "))


def _paragraphs(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as packed:
        body = packed.read("word/document.xml").decode("utf-8", "replace")
    lines = re.split(r"</w:p>", body)
    return "\n".join(html.unescape("".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", x))) for x in lines).strip()


def document(content: Column) -> Column:
    """The paragraphs of a word-processor file."""
    return extractor(_paragraphs)(content)["text"]


#: Functions from content to text by extension. A user's own, for types that need a library, go beside them.
BY_TYPE: dict[str, Callable[[Column], Column]] = {".txt": plain, ".md": plain, ".csv": plain, ".json": plain, ".py": plain, ".html": page, ".docx": document}


def extracted(files: DataFrame, name: str, content: str, by_type: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """files with ``text`` and ``status``: done, cut (text of the first LIMIT bytes only), empty, failed (the type's function gave nothing) or unsupported.

    The extension of ``name`` decides, whatever its case. The content is only
    handed to a Python function for the types that need one.
    """
    functions = BY_TYPE if by_type is None else by_type
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    text = F.lit(None).cast("string")
    for kind, function in functions.items():
        # A Python function runs for every row of its batch; null content keeps it from working on other types.
        text = F.when(ext == kind, function(F.when(ext == kind, F.col(content)))).otherwise(text)
    out = files.withColumn("text", text)
    status = F.when(~ext.isin(list(functions)), "unsupported").when(F.col("text").isNull(), "failed").when(F.trim("text") == "", "empty")
    limited = [kind for kind, function in functions.items() if function in (plain, page)]
    status = status.when(ext.isin(limited) & (F.length(content) > LIMIT), "cut").otherwise("done")
    return out.withColumn("status", status)
