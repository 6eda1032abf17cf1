"""Members of ZIP and tar archives as rows."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MEMBER = "container string, member string, bytes long, content binary, error string"
_COLUMNS = ["container", "member", "bytes", "content", "error"]
#: Bytes of a member's content at most; of a longer one there is a row without content.
MOST_BYTES = 256 << 20


def _safe(name: str) -> bool:
    return not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/") and ":" not in name[:3]


def zip_members(files: DataFrame, content: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(container, member, bytes, content, error) for files(path, content); folders and unsafe names are left out.

    A member that is encrypted, packed in an unknown way, damaged or too long
    has no content but an error; a broken archive, or null content, gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data))
                    members = [m for m in archive.infolist() if not m.is_dir() and _safe(m.filename)]
                    # One member at a time, so that an archive is never unpacked whole in memory.
                    for m in members:
                        held, error = None, "too long" if content and m.file_size > most_bytes else None
                        if content and not error:
                            try:
                                held = archive.read(m)
                            except (RuntimeError, NotImplementedError, zlib.error, EOFError, zipfile.BadZipFile) as e:
                                error = str(e) or type(e).__name__
                        yield pd.DataFrame([(path, m.filename, m.file_size, held, error)], columns=_COLUMNS)
                except (zipfile.BadZipFile, TypeError):
                    continue

    return files.select("path", "content").mapInPandas(run, MEMBER)


def tar_members(files: DataFrame, content: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The same for tar archives, packed or not; links and devices are left out, and what follows a damaged place is lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as archive:
                        for m in archive:
                            if m.isfile() and _safe(m.name):
                                error = "too long" if content and m.size > most_bytes else None
                                held = archive.extractfile(m).read() if content and not error else None
                                yield pd.DataFrame([(path, m.name, m.size, held, error)], columns=_COLUMNS)
                except (tarfile.TarError, TypeError, EOFError, OSError, zlib.error):
                    continue

    return files.select("path", "content").mapInPandas(run, MEMBER)
