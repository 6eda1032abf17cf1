"""Functions over Arrow batches for what built-in expressions can't say, and hooks for a user's own."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of the secret scan: name and pattern. Pass your own for other secrets.
SECRETS = {"token": r'token = "[0-9a-f]{40}"', "password": r"password=[0-9a-z]+", "key": r"AKIA[0-9A-Z]{16}"}
DELIMITERS = ",\t;|"


def _redacted(text: str, start: int, end: int) -> str:
    found = text[start:end]
    inner = found[:4] + "[REDACTED]" + found[-4:] if len(found) > 8 else "[REDACTED]"
    return text[max(0, start - 8) : start] + inner + text[end : end + 8]


def secret_matches(df: DataFrame, name: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(name, rule, start, context) of every match of every rule, with the secret itself redacted. Null texts have none."""
    compiled = {k: re.compile(p) for k, p in (rules or SECRETS).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, rule, m.start(), _redacted(t, *m.span()))
                for i, t in zip(batch["id"], batch["text"], strict=True) if t for rule, p in compiled.items() for m in p.finditer(t)
            ]
            yield pd.DataFrame(rows, columns=["id", "rule", "start", "context"])

    found = df.where(F.col(text).isNotNull() & F.col(name).isNotNull()).select(F.col(name).cast("long").alias("id"), F.col(text).alias("text"))
    return found.mapInPandas(run, "id long, rule string, start long, context string").withColumnRenamed("id", name)


def partial_ratio(needle: str, text: str) -> int:
    """0 to 100: the best share of a window as long as the needle that an in-order match keeps, by length of common subsequences."""
    return int(partial_ratios(needle, [text])[0])


def partial_ratios(needle: str, texts: list[str]) -> np.ndarray:
    """partial_ratio() of many texts: the windows of all of them go through the table of subsequences together."""
    out = np.zeros(len(texts), np.int64)
    if not needle:
        return out
    by_width: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if t:
            by_width.setdefault(min(len(needle), len(t)), []).append(i)
    for width, own in by_width.items():
        points = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in own]
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(p, width) for p in points])
        row = np.zeros((len(windows), width + 1), np.int32)
        for c in needle:
            last = row.copy()
            for j in range(1, width + 1):
                row[:, j] = np.where(windows[:, j - 1] == ord(c), last[:, j - 1] + 1, np.maximum(last[:, j], row[:, j - 1]))
        ends = np.cumsum([len(p) - width + 1 for p in points])
        best = np.maximum.reduceat(row[:, -1], np.concatenate([[0], ends[:-1]]))
        out[own] = np.rint(200 * best / (len(needle) + width))
    return out


def fuzzy(needle: str):
    """A column function: the partial ratio of a short needle in short texts such as titles."""
    return F.pandas_udf(lambda s: pd.Series(partial_ratios(needle.lower(), s.fillna("").str.lower().tolist())), "int")


def sniff_csv(text: str | None) -> tuple[list[str], str, int]:
    """(columns, delimiter, sample rows up to 200); a comma where no other delimiter is more frequent in the first line."""
    lines = (text or "")[: 512 * 1024].splitlines()
    if not lines:
        return [], ",", 0
    delimiter = max(DELIMITERS, key=lambda d: (lines[0].count(d), -DELIMITERS.index(d)))
    header = next(csv.reader(io.StringIO(lines[0]), delimiter=delimiter))
    return header, delimiter, min(200, len(lines) - 1)


def sniff_json(text: str | None) -> tuple[str, list[str]]:
    """(mode, first 60 keys in order) with mode empty, object, array, jsonl, scalar or unparseable."""
    text = (text or "").strip()
    if not text:
        return "empty", []
    keys = lambda x: sorted(x)[:60] if isinstance(x, dict) else []
    try:
        value = json.loads(text)
    except ValueError:
        try:
            return "jsonl", keys(json.loads(text.splitlines()[0])) if len(text.splitlines()) > 1 else 1 / 0
        except (ValueError, ZeroDivisionError):
            return "unparseable", []
    if isinstance(value, list):
        return "array", keys(value[0]) if value else []
    return ("object", keys(value)) if isinstance(value, dict) else ("scalar", [])


def json_sniffer():
    return F.pandas_udf(lambda s: pd.DataFrame([dict(zip(("mode", "keys"), sniff_json(t), strict=True)) for t in s]), "mode string, keys array<string>")


def csv_sniffer():
    return F.pandas_udf(lambda s: pd.DataFrame([dict(zip(("columns", "delimiter", "sample_rows"), sniff_csv(t), strict=True)) for t in s]), "columns array<string>, delimiter string, sample_rows int")


def extractor(function: Callable[[bytes], str]):
    """A user's bytes-to-text function as a column function to (text, error): what it raises on has no text but says why."""

    def one(content: bytes | None) -> tuple[str | None, str | None]:
        try:
            return (None if content is None else function(bytes(content))), None
        except Exception as e:  # noqa: BLE001  any decoder may raise anything on a broken file
            return None, f"{type(e).__name__}: {e}"

    return F.pandas_udf(lambda s: pd.DataFrame([one(x) for x in s], columns=["text", "error"]), "text string, error string")


def structured_extractor(function: Callable[[str], str], most: int = 10_000):
    """A user's function from a text's first ``most`` characters to JSON, as a column function; payloads.parsed() reads what it gives."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else function(t[:most])), "string")


def embedder(make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64):
    """A user's model, made once for each worker, as a column function from text to a vector."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v.tolist() for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])])

    return embed


def hashing_model(size: int = 32) -> Callable[[list[str]], np.ndarray]:
    """Word counts in hashed places, of length one: an embedder without a model."""
    from hashlib import md5

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                row[int(md5(word.encode()).hexdigest()[:8], 16) % size] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return model
