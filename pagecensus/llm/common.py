"""What the corpus operators share: table access, Arrow batches, word hashes, staging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagecensus.session import stage

__all__ = ["Table", "arrow_map", "load", "prepare", "shuffle_parts", "stage"]

# Rows an Arrow batch holds at most: documents are some kilobytes, so a batch is some megabytes.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of whole documents small; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus table, read by Spark from wherever ``sf_dir`` lies."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(
    rows: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` under one name, so that operators read alike."""
    return rows.mapInArrow(batches, schema)


class Table(dict):
    """A table of at most ``2 * limit`` recent entries: two generations, found entries move to the new one."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are unknown; the known ones can be looked up from now on."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        unknown = keys.difference(self)
        again = unknown.intersection(self.old)
        self.update((k, self.old[k]) for k in again)
        return unknown - again


# ---- hashing of words ------------------------------------------------------------------------

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(kind: str, base: np.uint64, size: int) -> np.ndarray:
    known = _POWERS.get(kind)
    if known is None or len(known) < size:
        grown = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        _POWERS[kind] = known = grown if size <= 1 << 21 else known
        if known is None or len(known) < size:
            return grown
    return known[:size]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``h[i]`` covers the first ``i`` bytes; differences give the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers("up", _MULTIPLIER, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``[start, end)``; equal bytes give equal hashes wherever they stand."""
    down = _powers("down", _INVERSE, len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than blanks and 0x09 to 0x0D."""
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, dtype=np.uint8)]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, in order."""
    starts, ends = word_spans(text)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return span_hashes(prefix_hashes(np.frombuffer(text, dtype=np.uint8)), starts, ends)


_WINDOW_FACTORS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words; empty if there are fewer words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = words[:count] * _WINDOW_FACTORS[0]
    for i in range(1, size):
        total = total + words[i : i + count] * _WINDOW_FACTORS[i % 64] * np.uint64(2 * (i // 64) + 1)
    return mixed(total)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """As ``window_hashes``, other values, in a time that does not grow with ``size``."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _powers("up", _MULTIPLIER, len(words)), out=prefix[1:])
    return mixed((prefix[size:] - prefix[:-size]) * _powers("down", _INVERSE, len(words))[:count])


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
