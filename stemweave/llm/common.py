"""Helpers shared by the training-data operators: written intermediate tables, joins of checked size, and vectorised hashing of words inside Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from ..operators.graph import scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, name: str, block: int = 128 << 20) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.  ``block`` bounds the
    bytes of a row group, which a task holds while it writes."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", block).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, or with underscores behind it where a column of that name is there (names are compared without case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def ascii_lower(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


# --------------------------------------------------------------------------- hashing of words

_M1, _M2, _R = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _R)
_LOWERED = _BYTES.copy()
_LOWERED[65:91] = _BYTES[97:123]
EXACT = _BYTES
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_SEGMENT = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls have length 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = column.buffers()[2]
    buf = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 2 << 20, rows: int = 4000):
    """Consecutive slices of a batch with about ``most`` bytes of text each; a longer text is a slice of its own."""
    _, off = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system, since workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


SMALL_ROWS = 500_000
SMALL_BYTES = 64 << 20
HOT_KEYS = 10_000


def _width(df: DataFrame):
    """Bytes of a row: 8 for a fixed value, the length of a string, and both for the entries of an array; a struct in an array counts 8 for each field and 16 more for a string."""

    def of(c, kind):
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            entry = 8 + sum(24 if isinstance(f.dataType, (StringType, BinaryType)) else 8 for f in kind.elementType)
            return F.greatest(F.size(c), F.lit(0)) * entry + 8
        if isinstance(kind, ArrayType):
            inner = F.octet_length(F.array_join(c, "")) if isinstance(kind.elementType, StringType) else F.lit(0)
            return F.greatest(F.size(c), F.lit(0)) * 8 + F.coalesce(inner, F.lit(0))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0)).cast("long")


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table that is already written, if its counted rows and bytes are few; else leave the join to Spark."""
    n, size = df.agg(F.count("*"), F.sum(_width(df))).first()
    return F.broadcast(df) if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else df


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """The written ``rows`` left-joined to the written ``groups(key, size, ...)``, one row a key, where a key may hold any share of
    the rows; keys are not null.

    A key with more than ``total / HOT_KEYS`` of the ``total`` rows is hot; there are fewer than ``HOT_KEYS`` of them, so they are
    broadcast.  The others meet by a shuffle, in which no key has more than that share.  ``size`` is not returned.
    """
    hot = F.col(size) * HOT_KEYS > total
    first, other = F.broadcast(groups.where(hot).drop(size)), groups.where(~hot).drop(size)
    return rows.join(first, key).unionByName(rows.join(first.select(key), key, "left_anti").join(other, key, "left"))


def word_hashes(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = _SPACE, letters: np.ndarray = _LOWERED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text: (hash, byte start, byte end, first word of each text).  They are ASCII-lower-cased,
    or with ``letters=EXACT`` as they stand."""
    is_sep = sep[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    word = ~is_sep
    prev, after = np.empty_like(word), np.empty_like(word)
    if len(buf):
        prev[0], prev[1:] = True, is_sep[:-1]
        after[-1], after[:-1] = True, is_sep[1:]
    start = np.flatnonzero(word & (prev | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # segments bound the memory of the running sums
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SEGMENT, "right")))
        a, b = start[i], end[j - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(letters[buf[a:b]] * _power(_R, b - a), out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * _power(_RINV, b - a)[s] + (e - s).astype(np.uint64) * _M2)
        i = j
    return out, start, end, np.searchsorted(start, off)


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text; a shorter text is one shingle, an empty one none."""
    buf, off = text_buffers(column)
    h, _, _, first = word_hashes(buf, off)
    n = len(h)
    if n >= width:
        k = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            k = mix(k * _R + h[i : n - width + 1 + i])
    else:
        k = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(k[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                x = mix(x * _M2 + h[i])
            out.append(x)
        else:
            out.append(k[:0])
    return out


def list_array(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """An Arrow list column of numpy rows."""
    sizes = np.array([len(p) for p in parts], np.int64)
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.astype(kind, copy=False)))
