"""Sequence packing by large-item matching and best fit, over tokenised documents.

A document becomes its token ids and an end id; what is longer than the capacity is cut into
pieces of the capacity. Pieces of over a third of the capacity (of which a sequence holds two at
most) are matched greedily, the longest first, each with the longest partner that still fits.
Shorter pieces then go, longest first, to the sequence whose gap they fill best; new sequences
open only when no gap is long enough.

A packing depends on lengths alone, and there are at most `capacity` lengths. The driver
therefore sees counts per length only, however many documents there are: it plans for runs of
equal pieces ("pieces r..r+k of length l go to sequences s..s+k at offset o"), and the pieces look
up their run by (length, rank within length). Ranks come from counts per (length, shard), so a
length that a third of all pieces share is ranked in many tasks. The plan is bounded by the
capacity, not by the input, and can be broadcast.

Defined cases: null or empty text is one piece that holds only the end id; repeated rows are
documents of their own; a null doc_id is kept; an empty table gives an empty result; other
columns are not read. Ties in rank are broken by doc_id, piece and checksum.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cache, claim, table, tidy, written

CAPACITY, END_ID = 2048, 0
assert array("I").itemsize == 4 and sys.byteorder == "little"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

_ENCODERS: dict[str, WordEncoder] = cache()
#: Control characters that str.split() takes for white space and Unicode does not, and the tokenizer's special strings.
_ODD = re.compile("[\x1c-\x1f]|<\\|(?:start|end)oftext\\|>")


_LATIN = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
#: Texts in which a run of letters can end within a run of _LATIN, or lower-casing changes the number of characters.
_OTHER = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]|'|<\\|")
_UNITS = re.compile(f"[{_LATIN}]+|[^\\s{_LATIN}]+")


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes, each distinct unit encoded once.

    The vocabulary lower-cases, and its pre-tokeniser never joins across white space, nor letters
    with what is no letter (but after an apostrophe). The units of a text in Latin script are
    therefore its lower-cased runs of letters and of other characters; those of other texts are
    its words; and texts with special strings are encoded whole. `keep` bounds what is remembered.
    """

    def __init__(self, path: str, keep: int = 500_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; every thread would hold memory of its own
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.longest, self.known = Tokenizer.from_file(path), keep, longest, {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        # some at a time, as what the library returns for a unit is large
        return [array("I", e.ids).tobytes() for at in range(0, len(texts), 2048) for e in self.tokenizer.encode_batch_fast(texts[at : at + 2048], add_special_tokens=False)]

    def _units(self, text: str | None) -> list[str] | None:
        if not text:
            return []
        if not _OTHER.search(text):
            return _UNITS.findall(text.lower())
        return None if _ODD.search(text) else text.split()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        units = [self._units(t) for t in texts]
        known = self.known
        new = set().union(*(u for u in units if u)) - known.keys()
        if new:
            if len(known) + len(new) > self.keep:
                known.clear()
                new = set().union(*(u for u in units if u))
            order = list(new)
            known.update(zip(order, self._encode(order), strict=True))
        get = known.__getitem__
        out = [self._encode([t])[0] if u is None else b"".join(map(get, u)) for t, u in zip(texts, units, strict=True)]
        for u in new:
            if len(u) > self.longest:
                del known[u]
        return out


def _pieces(path: str, capacity: int):
    def cut(batches):
        claim(__name__)
        encode = WordEncoder.of(path)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc, data in zip(ids, encode(batch.column(1).to_pylist()), strict=True):
                data += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: document, number in it, ids before it, length, checksum of its ids."""
    arrow_rows(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_pieces(vocabulary, capacity)), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, offset) for counts of pieces per length, and how many sequences they fill."""
    left = {k: v for k, v in counts.items() if v}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    order: list[int] = []  # the gaps there are, ascending
    opened = 0

    def gap(size: int, first: int, n: int) -> None:
        if size:
            if size not in gaps:
                gaps[size] = []
                order.insert(bisect_left(order, size), size)
            gaps[size].append((first, n))

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], first, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        fits = [k for k in large[: bisect_left(large, capacity - a + 1)] if left[k] > (k == a)]
        b = fits[-1] if fits else None
        n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        place(a, n, opened, 0)
        if b is not None:
            place(b, n, opened, a)
        gap(capacity - a - (b or 0), opened, n)
        opened += n
        large = [k for k in large if left[k]]
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at < len(order):
                size = order[at]
                first, n = gaps[size].pop()
                used = min(n, left[length])
                if used < n:
                    gaps[size].append((first + used, n - used))
                if not gaps[size]:
                    del gaps[size], order[at]
                place(length, used, first, capacity - size)
                gap(size - length, first, used)
            else:
                each = min(capacity // length, left[length])
                n = left[length] // each
                for k in range(each):
                    place(length, n, opened, k * length)
                gap(capacity - each * length, opened, n)
                opened += n
    return runs, opened


def _assign(runs):
    def look_up(batches):
        length, first_rank, sequence, offset = runs.value
        key = length << 44 | first_rank
        for b in batches:
            size, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(key, size << 44 | rank, side="right") - 1
            found = sequence[at] + rank - first_rank[at] if len(key) else size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(found), pa.array(offset[at])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return look_up


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, shard_rows: int = 200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """pieces() and, for each, the sequence it lies in and its offset there."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, capacity, doc_id, text), "pieces")
    shards = max(16, -(-cut.count() // shard_rows))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    held = cut.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    runs = spark.sparkContext.broadcast(np.array(sorted(runs), np.int64).reshape(-1, 4).T.copy())
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("r", F.row_number().over(within) - 1).join(held, ["length", "shard"])
    columns = [x.split()[0] for x in PIECES.split(", ")]
    return ranked.select(*columns, (F.col("r") + F.col("before")).cast("long").alias("rank")).mapInArrow(tidy(_assign(runs)), PACKED)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
