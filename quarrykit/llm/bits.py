"""A filter of 64-bit ids: it lets through all that were put in, and a few more.

Its size follows the number of ids up to a fixed most, so it can be broadcast
whatever the input. Beyond that it lets more through, which costs work only:
whoever uses it joins exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import scan

#: 64-bit words of a filter: the least, and the most (8 MB).
WORDS = (1 << 14, 1 << 20)


def _places(ids: np.ndarray, n_words: int) -> list[np.ndarray]:
    h = scan.mixed(ids.astype(np.int64).view(np.uint64))
    return [((h >> np.uint64(s)) & np.uint64(64 * n_words - 1)).astype(np.int64) for s in (0, 32)]


def filter_of(ids: DataFrame, n: int) -> np.ndarray:
    """The filter of about n ids(id), two bits each, of 16 to 64 bits for each while it may still grow."""
    n_words, most = WORDS
    while n_words < most and 4 * n_words < n:
        n_words *= 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_words, np.int64)
        for batch in batches:
            for place in _places(batch.column("id").to_numpy(), n_words):
                np.bitwise_or.at(bits, place >> 6, np.int64(1) << (place & 63))
        full = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(bits[full], pa.int64())], ["word", "bits"])

    found = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_words, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def passed(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter lets through."""
    out = np.ones(ids.size, bool)
    for place in _places(ids, bits.size):
        out &= (bits[place >> 6] >> (place & 63)) & 1 > 0
    return out
