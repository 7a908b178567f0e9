"""Shared pieces: tables, the shared work folder, and vectorised text hashing.

Text hashing works on a whole Arrow batch at once: the UTF-8 bytes of all texts lie in one
buffer, token bounds come from one table lookup per byte, and a token's 64-bit hash is a
difference of prefix sums. Nothing here loops over bytes or tokens in Python.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

U = np.uint64
#: Odd multiplier of the prefix hash and its inverse modulo 2**64, and the mixer's multipliers.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ASCII_SPACE = bytes([9, 10, 11, 12, 13, 32])


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark, rows: int = 1000) -> None:
    """Bound Arrow batches by rows, as a row can be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark) -> str:
    """The folder that driver and executors share; set only where a local session names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"/tmp/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def qualified(spark, path: str) -> str:
    """path with the scheme that Spark's readers and writers take it to have."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


#: Folders of the tables that written() has made and nobody has dropped yet, oldest first.
WRITTEN: list[str] = []


def written(df, name: str):
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark, paths: list[str]) -> None:
    """Delete tables that written() made, once no plan reads them any more."""
    for path in paths:
        with contextlib.suppress(Exception):  # a folder that stays is no harm to results
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


#: A key is hot when it holds more than this share of the rows, and HOT_ROWS at least; so at most 1 / HOT_SHARE keys are.
HOT_SHARE, HOT_ROWS = 1 / 2000, 500


def hot_join(df, key: str, right, right_key: str, how: str = "left", rows: int | None = None):
    """df joined with right, which has one row a right_key, on df[key] = right[right_key].

    Rows of hot keys stay where they are: the rows of right with these keys, at most 1 / HOT_SHARE,
    are broadcast. The others are joined by a shuffle, in which no key is hot. df and right are read
    more than once, so they should be tables.
    """
    rows = df.count() if rows is None else rows
    hot = []
    if rows > HOT_ROWS:
        held = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
        hot = [r[0] for r in held.where(F.col("__n") > max(HOT_ROWS, HOT_SHARE * rows)).select("__hot").collect()]  # at most 1 / HOT_SHARE
    on = lambda a, b: a.join(b, a[key] == b[right_key], how)
    if not hot:
        return on(df, right)
    is_hot = F.coalesce(df[key].isin(hot), F.lit(False))
    return on(df.where(is_hot), F.broadcast(right.where(F.col(right_key).isin(hot)))).unionByName(on(df.where(~is_hot), right.where(~F.coalesce(F.col(right_key).isin(hot), F.lit(False)))))


_CACHES: list[dict] = []
_OWNER: list[str] = []


def cache() -> dict:
    """A dict that lives in a Python worker while tasks of the same module run in it."""
    _CACHES.append({})
    return _CACHES[-1]


def release() -> None:
    """Give freed memory back to the system, as the driver's Python does after it has trained a model."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def claim(owner: str) -> None:
    """Called as a task or group begins: a reused worker gives back what the one before has left, and other modules' caches."""
    if _OWNER != [owner]:
        _OWNER[:] = [owner]
        for c in _CACHES:
            c.clear()
    release()


def tidy(run):
    """A function for mapInArrow that gives memory back when its task ends, so that an idle worker holds little."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that nearby hashes differ in all bits."""
    h = h ^ (h >> U(30))
    h = h * U(MIX[0])
    h ^= h >> U(27)
    h *= U(MIX[1])
    h ^= h >> U(31)
    return h


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(BASE))  # a random value for each byte
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; grown when needed, kept by the worker."""
    if len(_POW.get("p", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for key, b in (("p", BASE), ("q", inverse)):
            x = np.full(size, b, dtype=U)
            x[0] = 1
            _POW[key] = np.multiply.accumulate(x)
    return _POW["p"], _POW["q"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, null as empty, and the n + 1 offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if n and data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(ASCII_SPACE)] = True
#: For operators that look at words without punctuation: ASCII other than letters and digits parts words.
IS_PUNCT = np.ones(256, bool)
IS_PUNCT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    IS_PUNCT[_a:_b] = False


def tokens(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each maximal run of bytes that are no gap, within its document."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~gap[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[tails] = inside[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def token_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each token's bytes, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, U)
    value = _BYTE[LOWER] if lower else _BYTE
    out = np.empty(len(starts), U)
    step = 1 << 20  # bytes at a time, so that the sums stay in cache
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + step, side="right")))
        hi = ends[to - 1]
        p, q = _powers(int(hi - lo) + 1)
        sums = np.zeros(int(hi - lo) + 1, U)
        np.cumsum(value[raw[lo:hi]] * p[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * q[s]
        at = to
    return mix64(out + (ends - starts).astype(U) * U(BASE))


def gram_hashes(h: np.ndarray, n: int, *, skip: int = 0) -> np.ndarray:
    """Hashes of the n-grams that begin at each token but the last n - 1 (skip: tokens left out between two)."""
    span = (n - 1) * (skip + 1)
    if len(h) <= span:
        return np.zeros(0, U)
    out = np.full(len(h) - span, n * 2654435761 + skip, dtype=U)
    for k in range(n):
        out = out * U(BASE) + h[k * (skip + 1) : len(h) - span + k * (skip + 1)]
    return mix64(out)
