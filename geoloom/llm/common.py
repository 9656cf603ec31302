"""Shared parts of the training-data operators: Arrow text access, vectorised
token hashing and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
_ODD = 0x9E3779B97F4A7C15
_P = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where it is
    unset, a new one of this machine, if all executors are on it (tests); on a
    cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES):
    """Plans run inside send Arrow batches of at most so many bytes to Python:
    wide rows fill Spark's 64 MB, which JVM and worker hold several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the
    lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    if not _left:
        atexit.register(_sweep)
    _left[path] = spark
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again. What a result still
    reads goes when the session's process ends."""
    for df in tables:
        if _left.pop(df._staged_path, None):
            _delete(df.sparkSession, df._staged_path)


def _sweep() -> None:
    for path, spark in _left.items():
        try:
            _delete(spark, path)
        except Exception:  # the session ended before
            return


try:
    _trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library
    _trim = None


def give_back() -> None:
    """Return the memory that freed arrays leave in a worker's heap: workers
    live on between tasks beside others on the same executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of text. A row is
    never cut: a longer text makes a run of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; NULL is ''."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        inverse = pow(_P, -1, 1 << 64)
        for key, base in (("p", _P), ("i", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_ODD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _plain_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64)
    t[:33] = 0
    return t


def _folded_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64)
    for b in range(128):
        c = chr(b)
        t[b] = ord(c.lower()) if c.isalnum() else 0
    return t


PLAIN, FOLDED = _plain_table(), _folded_table()


def _marks(data: np.ndarray) -> np.ndarray:
    """Positions of the bytes of U+0080 to U+00BF and U+2000 to U+207F."""
    two = np.flatnonzero(data == 0xC2)
    three = np.flatnonzero(data == 0xE2)
    three = three[(data[three + 1] & 0xFE) == 0x80]
    return np.concatenate([two, two + 1, three, three + 1, three + 2])


def tokens(data: np.ndarray, offsets: np.ndarray, fold: bool = False):
    """(hash, first byte, byte after the last, document row) of each token.

    A token is a run of bytes above 0x20, or with `fold` a run of ASCII letters
    and digits, in lower case, and of other characters but U+0080 to U+00BF and
    U+2000 to U+207F (spaces, quotes, dashes). Texts are never joined: a token
    ends where its document ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    code = (FOLDED if fold else PLAIN)[data]
    if fold:
        code[_marks(data)] = 0
    solid = code != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    first = np.flatnonzero(solid & (~before | edge[:n]))
    last = np.flatnonzero(solid & (~after | edge[1:])) + 1
    p, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code * p[:n], out=total[1:], dtype=np.uint64)
    h = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return h, first, last, np.searchsorted(offsets, first, "right") - 1


def spans_hash(h: np.ndarray, first: np.ndarray, length) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of the token runs h[first:first+length]."""
    n = len(h)
    p, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p[:n], out=total[1:], dtype=np.uint64)
    return mix((total[first + length] - total[first]) * inverse[first])


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values."""
    n = len(sorted_values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
    return start, np.diff(np.append(start, n))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


#: Between two folded tokens, as a regular expression of DuckDB, Java and Python.
FOLD_BREAK = r"[\x00-/:-@\[-`{-\x7f\u0080-\u00bf\u2000-\u207f]+"
#: The same for DuckDB.
FOLD_BREAK_SQL = r"[\x00-/:-@\[-`{-\x7f\x{80}-\x{bf}\x{2000}-\x{207f}]+"


def member(values: np.ndarray, known: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which values are in the sorted `known`; bitmap from bitmap_of(known)."""
    maybe = np.flatnonzero(bitmap[(values & np.uint64(len(bitmap) - 1)).astype(np.int64)])
    out = np.zeros(len(values), bool)
    if len(known) and len(maybe):
        at = np.searchsorted(known, values[maybe])
        out[maybe] = known[np.minimum(at, len(known) - 1)] == values[maybe]
    return out


def bitmap_of(known: np.ndarray) -> np.ndarray:
    size = 1 << max(16, int(len(known) * 16).bit_length())
    out = np.zeros(size, bool)
    out[(known & np.uint64(size - 1)).astype(np.int64)] = True
    return out
