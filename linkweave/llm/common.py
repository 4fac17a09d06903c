"""Helpers shared by the training-data operators.

Texts are handled as the bytes of whole Arrow batches: a batch is cut into slices of
about ``SLICE`` bytes (a longer text is a slice of its own), so working arrays stay small
and no text is ever cut. Nulls count as empty texts.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import shared_folder

SLICE = 1 << 20

#: The word separators of the contracts: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_FORTH = _powers(int(_BASE), SLICE + 1)
_BACK = _powers(pow(int(_BASE), -1, 1 << 64), SLICE + 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_FORTH):
        return _FORTH, _BACK
    return _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a working table into the cluster's shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/linkweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: str):
    """Rows that are run inside go to Python in batches of about ``size``."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held(column: str, modulus: int):
    """The remainder that sets rows apart for testing: crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``bytes, offsets`` of an Arrow string or binary array; null is empty."""
    kind = pa.large_binary()
    array = pc.fill_null(texts.cast(pa.large_string() if pa.types.is_string(texts.type) else kind), "" if pa.types.is_string(texts.type) else b"")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if buffers[2] is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str):
    """``(rows, bytes, offsets)`` for runs of rows with about SLICE bytes of text."""
    if not batch.num_rows:
        return
    data, offsets = flat(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        o = offsets[first : last + 1]
        yield batch.slice(first, last - first), data[o[0] : o[-1]], o - o[0]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, row`` of every word; a word never crosses two texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~IS_SPACE[data]
    left = np.empty(n, bool)
    left[0] = True
    np.logical_not(solid[:-1], out=left[1:])
    left[offsets[:-1][offsets[:-1] < n]] = True
    right = np.empty(n, bool)
    right[-1] = True
    np.logical_not(solid[1:], out=right[:-1])
    ends = offsets[1:]
    right[ends[ends > 0] - 1] = True
    starts = np.flatnonzero(solid & left)
    return starts, np.flatnonzero(solid & right) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hasher(data: np.ndarray):
    """``span_hashes`` of one array of bytes, whose running sums are made once."""
    forth, back = _tables(len(data) + 1)
    x = _BYTE[data]
    x *= forth[: len(data)]
    total = np.cumsum(x, dtype=np.uint64)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        h = (total[ends - 1] - total[starts] + x[starts]) * back[starts]
        return mix64(h + (ends - starts).astype(np.uint64))

    return hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-empty) span of bytes, equal for equal bytes."""
    return span_hasher(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int):
    """``hashes, rows, first word`` of the runs of ``size`` words of each text.

    A text with fewer words gives its whole sequence as one shingle; without words, none.
    """
    count = np.bincount(rows, minlength=n_rows)
    acc = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    weight = _powers(int(_BASE), size + 1)[1:]
    for k in range(size):
        acc += hashes[k : k + len(acc)] * weight[k]
    whole = rows[: len(acc)] == rows[size - 1 :][: len(acc)] if len(acc) else np.zeros(0, bool)
    first = np.flatnonzero(whole)
    out = mix64(acc[first])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.searchsorted(rows, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            extra[has] += hashes[begin[has] + k] * weight[k]
        extra = mix64(extra + count[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out, first = np.concatenate([out, extra]), np.concatenate([first, begin])
        order = np.argsort(first, kind="stable")
        out, first = out[order], first[order]
    return out, rows[first], first


def tables(batch_rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(batch_rows[f.name], f.type) for f in schema], schema=schema
    )
