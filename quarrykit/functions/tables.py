"""Table functions for SQL: chunks of a text, its secrets, archive members, and the first rows of partitions.

``register(spark)`` gives a session all of them by name; they are called with
LATERAL, or with TABLE(...) PARTITION BY for those that take a table.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarrykit.functions import udfs

_WORD = re.compile(r"[^ \t\n\r\f]+")


class Chunks:
    """(chunk, part) of a text: windows of ``size`` words, each ``stride`` words behind the last, joined by spaces. Null or blank text has none."""

    def eval(self, text: str, size: int = 600, stride: int = 520) -> Iterator[tuple[int, str]]:
        if size is None or stride is None or size < 1 or stride < 1:
            raise ValueError("size and stride are 1 or more")
        words = _WORD.findall(text or "")
        for i, at in enumerate(range(0, len(words), stride)):
            yield i, " ".join(words[at : at + size])


class Secrets:
    """(rule, start, context) of each match in a text, the secret itself redacted. ``rules`` is a JSON object of names and patterns; null means the library's own."""

    def __init__(self) -> None:
        self._of: dict[str | None, dict[str, re.Pattern]] = {}

    def eval(self, text: str, rules: str | None = None) -> Iterator[tuple[str, int, str]]:
        if rules not in self._of:
            self._of[rules] = {k: re.compile(p) for k, p in (json.loads(rules) if rules else udfs.SECRETS).items()}
        for rule, pattern in self._of[rules].items():
            for m in pattern.finditer(text or ""):
                yield rule, m.start(), udfs._redacted(text, *m.span())


class Members:
    """(member, bytes, error) of a zip archive; folders are left out, and what is no archive is one row that says so."""

    def eval(self, content: bytes) -> Iterator[tuple[str | None, int | None, str | None]]:
        if content is None:
            return
        try:
            found = [(i.filename, i.file_size, None) for i in zipfile.ZipFile(io.BytesIO(content)).infolist() if not i.is_dir()]
        except zipfile.BadZipFile as e:
            found = [(None, None, str(e))]
        yield from found


class FirstOf:
    """The first rows of each partition in its order, as they are, and their ``place`` from 1.

    Takes any table: analyze() passes its columns on. It asks for a partitioned
    table, holds no rows, and counts on after the last one that it wants.
    """

    def __init__(self) -> None:
        self._n = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table: TABLE(t) PARTITION BY key ORDER BY ...")
        if not isinstance(most.value, int) or most.value < 1:
            raise ValueError("the second argument is a constant of 1 or more")
        if "place" in [f.name.lower() for f in rows.dataType.fields]:
            raise ValueError("the table has a column named place")
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("place", LongType())]))

    def eval(self, rows: Row, most: int) -> Iterator[tuple]:
        self._n += 1
        if self._n <= most:
            yield (*rows, self._n)


TABLE_FUNCTIONS = {
    "text_chunks": (Chunks, "chunk int, part string"), "secret_matches": (Secrets, "rule string, start long, context string"),
    "zip_members": (Members, "member string, bytes long, error string"), "first_rows": (FirstOf, None),
}


def register(spark: SparkSession) -> None:
    """All table functions of this module, for SQL in this session. The executors need the package: see plans.shipping.ship()."""
    for name, (made, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=schema) if schema else udtf(made))
