"""Shared pieces of the corpus operators: a shared work folder and byte-level text kernels.

The kernels work on the value buffer of an Arrow string column, so a block of documents is tokenised and hashed
with a fixed number of numpy calls, whatever the number of documents in it.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Text bytes worked on at once; bounds a Python worker's memory.
BLOCK = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH = str(4 << 20)


def shared_dir(spark) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where that is unset an own one is set, in local mode only (tests); on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base:  # a path of the default file system
        p = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
        if base.startswith("file:/"):
            base = "file:///" + base.removeprefix("file:").lstrip("/")
    return base.rstrip("/")


_written: list[str] = []


def new_path(spark, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _written[-1]


def materialise(df, name: str):
    """Write df to the shared folder and read it again: cuts the lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables) -> None:
    """Deletes what materialise() wrote for the tables (None: nothing), once all that was made of them is written itself."""
    for df in tables:
        if df is not None:
            _delete(df.sparkSession, df.written_to)


def _delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def written() -> list[str]:
    """Paths of the intermediate tables that are there."""
    return list(_written)


def tidy(out, before: list[str], *also) -> None:
    """Once `out` is written: deletes the intermediate tables made for it, those that weren't there `before`, and the tables `also`, if they were materialised."""
    for path in set(_written) - set(before) - {out.written_to}:
        _delete(out.sparkSession, path)
    discard(*(df for df in also if "written_to" in vars(df)))


def clear(spark) -> None:
    """Deletes all intermediate tables of this process. Results are read from them, so they are kept until the caller has written or taken what it needs."""
    for path in list(_written):
        _delete(spark, path)


def bounded_batches(spark) -> None:
    """Arrow batches of a few MB: 10,000 long texts at once would take hundreds of MB outside the heap and again in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def trim() -> None:
    """Gives freed memory back to the system: workers live on from task to task."""
    if _trim:
        _trim(0)


def free_name(columns, name: str) -> str:
    """name, with underscores added until no column of the input is it or begins with it and an underscore (case-insensitively)."""
    taken = [c.lower() for c in columns]
    while any(c == name.lower() or c.startswith(name.lower() + "_") for c in taken):
        name = "_" + name
    return name


# == Arrow blocks


@lru_cache(1)
def _worker_pool() -> None:
    """In a Python worker: Arrow's own allocators keep what they have had, the system's doesn't."""
    pa.set_memory_pool(pa.system_memory_pool())


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if TaskContext.get() is not None:
        _worker_pool()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(raw: np.ndarray, off: np.ndarray, most: int = BLOCK):
    """Cut into runs of whole documents of about `most` bytes: yields (first row, bytes, offsets)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    trim()


# == tokens

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _PINV)):
            x = np.full(max(n, BLOCK + 4096), p, U64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 for letters, marks and numbers, and 2 more for upper case."""
    kind = {"L": 1, "M": 1, "N": 1}
    return np.fromiter((3 if c in ("Lu", "Lt") else kind.get(c[0], 0) for c in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, kind) of the characters beyond ASCII."""
    at = np.flatnonzero(raw >= 0xC0)
    lead = raw[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & (0x7F >> size)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        code[more] = code[more] << 6 | raw[np.minimum(at[more] + k, len(raw) - 1)] & 0x3F
    return at, size, _kinds()[np.minimum(code, 0x10FFFF)] if len(at) else np.zeros(0, np.uint8)


def fold(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) in lower case; bytes that aren't UTF-8 are folded as ASCII."""
    if not len(raw) or raw.max() < 0x80:
        return _LOWER[raw], off
    try:
        return string_parts(pc.utf8_lower(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(raw))))
    except pa.ArrowInvalid:
        return _LOWER[raw], off


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: maximal runs of letters, marks and numbers; none crosses a document's end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = _WORD[raw]
    at, size, kind = code_points(raw)
    member = kind > 0
    for k in range(4):
        more = at[member & (size > k)]
        if not len(more):
            break
        w[np.minimum(more + k, len(raw) - 1)] = True
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], w[:-1]))
    after = np.concatenate((w[1:], [False]))
    return np.flatnonzero(w & (~before | edge[:-1])), np.flatnonzero(w & (~after | edge[1:])) + 1


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes."""
    pw, inv = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * pw[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each document's first word): words are runs of letters, marks and numbers of any script, in lower case."""
    raw, off = fold(raw, off)
    starts, ends = word_spans(raw, off)
    return span_hash(raw, starts, ends), np.searchsorted(starts, off)
