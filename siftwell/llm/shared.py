"""Helpers of this subpackage: shared storage, and vectorised words over Arrow text columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str, DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session takes a temporary folder, a cluster its warehouse.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            at = tempfile.mkdtemp(prefix="siftwell-")
        else:
            at = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, free: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    ``free`` lets Spark drop the shuffle files that made it, so that disk does not add up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _MADE.append((spark, path, back))
    del df  # else its own shuffle files outlive the collection below
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``written`` returned as ``df``; nothing that is still to run may read it."""
    at = next((i for i, x in enumerate(_MADE) if x[2] is df), None)
    if at is not None:
        _delete(*_MADE.pop(at)[:2])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written() -> None:
    """Delete what ``written`` has left; results that still read it must be stored before."""
    while _MADE:
        try:
            _delete(*_MADE.pop()[:2])
        except Exception:  # the session may be gone at exit
            return


atexit.register(drop_written)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns under fixed names and types, so that further columns cannot clash: name="column:type"."""
    out = []
    for name, at in columns.items():
        column, _, kind = at.partition(":")
        out.append(df[f"`{column}`"].cast(kind).alias(name) if kind else df[f"`{column}`"].alias(name))
    return df.select(*out)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name, have = stem, {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# --- text as arrays -------------------------------------------------------------------------

#: White space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n at least; kept by the process."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def feature_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As span_hashes, by sums of powers: for hashed features only, as texts can be made that collide here."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Spans of more bytes than this are hashed one by one.
_LONG = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; behind the end come zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time are stirred into a state that every bit of it reaches, so no pattern in the bytes
    cancels out; spans above ``_LONG`` bytes take BLAKE2.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    n, view = ends - starts, eights(data)
    h = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1 + (seed << 32)))
    h = mix((h ^ (view[starts] & _KEEP[np.minimum(n, 8)])) + np.uint64(0x9E3779B97F4A7C15))
    rest = np.flatnonzero((n > 8) & (n <= _LONG))
    at = 8
    while len(rest):
        left = n[rest] - at
        h[rest] = mix((h[rest] ^ (view[starts[rest] + at] & _KEEP[np.minimum(left, 8)])) + np.uint64(0x9E3779B97F4A7C15))
        rest, at = rest[left > 8], at + 8
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, person=seed.to_bytes(8, "little")).digest(), "little")
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.string()), False
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def release() -> None:
    """Give memory that is free back to the system: workers live on from task to task and would add it up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text, so that memory does not hang on Arrow's batch size.

    A longer text comes alone and whole.
    """
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and for each document the index of its first word.

    gap: the bytes between words."""
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` word hashes from each position on; the last width - 1 positions have none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _STEPS[0]
    for j in range(1, width):
        total = total + h[j : j + n] * _STEPS[j]
    return mix(total)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each document its distinct shingles as sorted 64-bit hashes.

    Fewer words than ``width``: their whole sequence is the one shingle; no words: the empty set.
    """
    starts, ends, at = words(data, off)
    h = span_hashes(data, starts, ends)
    g = grams(h, width)
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = int(b - a)
        if n >= width:
            yield np.unique(g[a : b - width + 1])
        elif n:
            yield mix((h[a:b] * _STEPS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


#: Bits of the filter that likely() sends to all executors.
FILTER_BITS = 1 << 25


def _filter_places(x: np.ndarray) -> np.ndarray:
    h = mix(x.view(np.uint64))
    return np.stack([(h >> np.uint64(s)) & np.uint64(FILTER_BITS - 1) for s in (0, 20, 39)])


def likely(ids: DataFrame):
    """A Bloom filter of a column of longs, of fixed size, as a function of arrays of longs.

    It only saves work: all rows wanted pass, and the exact join comes after.
    """

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_filter_places(batch.column(0).to_numpy(zero_copy_only=False)).ravel()] = True
        if bits.any():
            at = np.flatnonzero(np.packbits(bits))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.packbits(bits)[at].astype(np.int16))], ["at", "bits"])

    merged = ids.mapInArrow(run, "at long, bits short").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in merged.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()

    def has(x: np.ndarray) -> np.ndarray:
        at = _filter_places(x)
        return ((table[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(0)

    return has


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow, named so that callers read alike."""
    return df.mapInArrow(fn, schema)


__all__ = ["binary_array", "discard", "drop_written", "eights", "feature_hashes", "fresh", "grams", "likely", "map_arrow", "mix", "pick", "release", "shared_dir", "shingle_sets", "slices", "span_hashes", "text_buffers", "words", "written"]
