"""Shared helpers: the cluster's shared folder, written intermediate tables, vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    Where none is set, a local session gets one of its own; a cluster can't, and is told so.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/shardloom-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes stored tables that nothing reads any more; names that aren't there are passed over."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = 8 << 20  # of an Arrow batch; whole rows, so a longer text is a batch of its own


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are of BATCH_BYTES at most: tasks hold a few copies of a batch."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not re.fullmatch(r"\d+b?", now := conf.get(key)) or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def tidied(run):
    """A task function that gives the memory it has freed back to the system when it ends: Python workers are used again."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not there outside glibc
                ctypes.CDLL(None).malloc_trim(0)

    return task


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    The shuffles behind the written table are dropped as soon as it is complete.
    """
    spark, path = df.sparkSession, f"{folder}/{name}"
    with _dropping_shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that is never broadcast: it grows with the input.

    Spark takes a written table for as small as its packed files are. What it broadcasts then is
    unpacked in the driver, many times as large, once a join.
    """
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- vectorised text ---------------------------------------------------------------------------

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


KEPT_POWERS = 1 << 21  # more, for a very long text, are made and dropped again


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (BASE, UNBASE):
        out = np.full(max(n, min(KEPT_POWERS, 1 << max(16, (n - 1).bit_length()))), base, np.uint64)
        out[0] = 1
        made.append(np.multiply.accumulate(out, out=out))
    if len(made[0]) <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit number for an ordered pair."""
    return mix(a * np.uint64(0xA0761D6478BD642F) + mix(b) + np.uint64(0x632BE59BD9B4E019))


PIECE = 64


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each span, from one prefix sum.

    A polynomial modulo 2**64 is the same for some long sequences whatever its base and values are, so a longer span is a chain of pieces.
    """
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    piece = lambda a, b: (total[b] - total[a]) * down[a]
    out = piece(starts, np.minimum(ends, starts + PIECE))
    left = np.flatnonzero(ends - starts > PIECE)
    at = starts[left] + PIECE
    while len(left):
        stop = np.minimum(at + PIECE, ends[left])
        out[left] = pair(out[left], piece(at, stop))
        more = stop < ends[left]
        left, at = left[more], stop[more]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and n + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, budget: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of whole rows with about `budget` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + budget, "right")))
            yield batch.slice(start, end - start)
            start = end


def words(body: np.ndarray, at: np.ndarray, letters: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: text number, first byte, end byte, hash."""
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    dark = ~WHITE[body]
    cut = np.zeros(len(body) + 1, bool)
    cut[at] = True
    begins, ends = dark.copy(), dark.copy()
    begins[1:] &= ~dark[:-1] | cut[1:-1]
    ends[:-1] &= ~dark[1:] | cut[1:-1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(at, first, "right") - 1, first, end, span_hashes(letters[body], first, end)
