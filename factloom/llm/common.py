"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Largest number of rows that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 400_000

#: The setting under which files of shuffles go at the end of a query, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The setting that bounds an Arrow batch in bytes, and what ``in_arrow`` lowers it to: a batch is held twice and more on both sides of a Python worker, outside the heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: ASCII upper to lower case, the only folding that the word definition asks for.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one beside the warehouse.

    A local session has no other machines to share with; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_factloom"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened by underscores until no column of ``df`` is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Files of the shuffles of actions inside go as soon as each action ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Files of its shuffles go as soon as it is written. The table is removed when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and that nothing reads any more."""
    for df in frames:
        files = df.inputFiles()
        for item in [x for x in _made if files and x[1].rpartition("/")[2] in files[0]]:
            _remove(*item)
            _made.remove(item)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for item in _made:
        try:
            _remove(*item)
        except Exception:  # the JVM may be gone: nothing is left to tidy with
            return


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unchanged, so that the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def release() -> None:
    """Give back to the system what this process has freed; workers are kept from task to task, and so would be the peaks of all of them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` for rows with whole texts: the session's batches are BATCH_BYTES at most from now on, and a task leaves no memory behind."""
    spark = df.sparkSession
    if int(re.sub(r"\D", "", spark.conf.get(BATCH))) > BATCH_BYTES or not spark.conf.get(BATCH).rstrip("b").isdigit():
        spark.conf.set(BATCH, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def texts_of(column: pa.Array) -> list[bytes]:
    """Text values as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text at most (or a single row)."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.array([0 if x is None else x for x in pc.binary_length(col).to_pylist()], dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_COMPARED = 1 << 20


def _span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of the spans [start, end), by prefix sums of a polynomial modulo 2**64: equal spans have equal keys, the rest is checked."""
    n = len(data) + 1
    size = 1 << (n - 1).bit_length()
    if size not in _cache:
        _cache.clear()
        _cache[size] = _powers(size, _BASE), _powers(size, _INVERSE)
    up, down = _cache[size]
    prefix = np.zeros(n, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: n - 1], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def _differing(data: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Spans whose bytes are not those of span ``like`` of each; compared in blocks of about _COMPARED bytes."""
    size = end - start
    bad = size != size[like]
    rows = np.flatnonzero(~bad & (like != np.arange(len(like))))
    cuts = np.searchsorted(np.cumsum(size[rows]), np.arange(0, int(size[rows].sum()) + 1, _COMPARED))
    cuts = np.unique(np.r_[0, cuts, len(rows)])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        part = rows[lo:hi]
        n = size[part]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        same = data[step + np.repeat(start[part], n)] == data[step + np.repeat(start[like[part]], n)]
        bad[part[~np.logical_and.reduceat(same, first)]] = True
    return np.flatnonzero(bad)


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings among non-empty spans, and the place of each span's among them; told apart by their bytes."""
    if not len(start):
        return [], np.zeros(0, dtype=np.int64)
    _, first, back = np.unique(_span_keys(data, start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    out = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]
    odd = _differing(data, start, end, first[back])
    if len(odd):  # another string has the same key
        seen = {w: i for i, w in enumerate(out)}
        for i in odd.tolist():
            back[i] = seen.setdefault(raw[start[i] : end[i]], len(seen))
        out = list(seen)
    return out, back


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit xxh3 of each span's bytes, worked out once for each distinct string."""
    strings, back = distinct_spans(data, start, end)
    return np.array([xxhash.xxh3_64_intdigest(w) for w in strings], dtype=np.uint64)[back]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, lower-cased, with the words' starts, ends and the number of words of each text.

    A word is a run of bytes other than space and 0x09 to 0x0D.
    """
    data = np.frombuffer(b"\n".join(texts).translate(ASCII_LOWER) + b"\n", dtype=np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, start, end, np.diff(np.searchsorted(start, bounds))
