"""What the training-data operators share: table access, cut lineage, and word arithmetic on byte buffers.

Words are runs of bytes outside space and 0x09-0x0D; only A-Z is lower-cased, so everything
works on UTF-8 bytes without decoding. A task holds one block of texts at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialise, release, scratch, shared_dir  # noqa: F401  for the operators

#: Bytes of text that one numpy pass takes at most, but for a single longer text.
BLOCK_BYTES = 300_000
#: Bytes of an Arrow batch between the JVM and Python, unless the session's own limit is lower.
BATCH_BYTES = 2 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _ends(col: pa.Array) -> np.ndarray:
    """Where each value of a string or binary column begins in its buffer, and the end."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind, size = (np.int64, 8) if wide else (np.int32, 4)
    return np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * size).astype(np.int64)


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about `most` bytes in all."""
    col = batch.column(column)
    ends = _ends(col) if len(col) else np.zeros(1, np.int64)
    start = 0
    while start < len(col):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, min(stop, len(col))
        start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each starts (one more entry for the end). Nulls count as empty."""
    if col.null_count:
        col = col.fill_null(pa.scalar(b"", col.type) if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    ends, data = _ends(col), col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_powers = np.ones(1, _U), np.ones(1, _U)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]), dtype=_U) for b in (_BASE, inverse))
    return _powers


class Words:
    """The words of a block of texts: 64-bit hash, text, first byte and end of each, in order.

    A word's hash is a polynomial in its bytes modulo 2**64, from prefix sums over the block,
    finished by mix(); the same word has the same hash everywhere.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lower: bool = True):
        self.raw, self.starts = raw, starts
        n = len(raw)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        inside = ~space
        first = inside.copy()
        if n:
            cut = np.zeros(n + 1, bool)
            cut[starts[:-1]] = True  # no word crosses from one text into the next
            cut = cut[:n]
            first[1:] = inside[1:] & (space[:-1] | cut[1:])
            last = inside.copy()
            last[:-1] = inside[:-1] & (space[1:] | cut[1:])
            self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.begin = self.end = np.zeros(0, np.int64)
        self.doc_at = np.searchsorted(self.begin, starts)  # first word of each text, and the end
        self.count = np.diff(self.doc_at)
        self.doc = np.repeat(np.arange(len(starts) - 1), self.count)
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
        self.folded = raw
        up, down = _powers_to(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, _U)
            np.cumsum((raw.astype(_U) + _U(1)) * up[:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(_U) * _U(0xD6E8FEB86659FD93))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of n words within a text, in order."""
        size = len(self.hash)
        if size < n:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: size - n + 1] == self.doc[n - 1 :])
        with np.errstate(over="ignore"):
            out = np.full(len(at), n, _U)
            for k in range(n):
                out = (out ^ self.hash[at + k]) * _U(0x9FB21C651E98DF25)
                out ^= out >> _U(29)
            return mix(out), at


def ship() -> None:
    """Puts the folder of this package on the path of Python workers, where it is not installed, and bounds Arrow batches."""
    sc = SparkContext._active_spark_context
    spark = SparkSession.getActiveSession()
    if spark is not None:
        most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH, "64m"))
        if most <= 0 or most > BATCH_BYTES:
            spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    if sc is not None:
        root = str(Path(__file__).resolve().parents[2])
        had = sc.environment.get("PYTHONPATH", "")
        if root not in had.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, had]))


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their stage, and idle beside those of the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow for functions of one record batch."""

    ship()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def texts_udf(function, schema: str):
    """A column function over whole texts. function: takes the bytes of a block of texts and their starts, returns a dict of arrays, one entry a text."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ship()
    kind = _parse_datatype_string(schema)

    def run(col: pa.Array) -> pa.Array:
        arrow = to_arrow_type(kind)
        batch = pa.RecordBatch.from_arrays([col], ["t"])
        parts = []
        for start, stop in blocks(batch, "t"):
            got = function(*text_bytes(col.slice(start, stop - start)))
            parts.append(pa.StructArray.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], fields=list(arrow)))
        give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)
