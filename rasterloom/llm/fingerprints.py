"""I-Match document fingerprints over fixed randomised lexicon subsets.

A document's terms are its distinct lower-cased words that lie in a band of inverse document
frequency. Document frequencies are counted exactly, by the terms' 64-bit hashes, over all documents;
a term is in the band from `LEAST` to `MOST` of the documents, so the lexicon has at most (words a
document) / LEAST terms whatever the corpus, and is broadcast as sorted hashes.

The lexicon subsets are drawn once and are the same for all documents. `WIDE` of them are I-Match's
own: the whole lexicon, then random subsets that each leave out a third of it. The others are thin
ones, for texts of which a part is edited: for each level, `SUBSETS` random parts of a share of
2**-level each. The hash of a subset is over the document's terms in it, sorted; an empty one is 0.
A fingerprint holds the wide hashes, and the thin ones at the level at which a subset holds one or
two of the document's terms and at the next finer one, as an edited text can have slightly more terms.

The likeness of two fingerprints is the share of equal hashes among the thin subsets that are not
empty in both, at a level which both carry; it is 1 if the hash over the whole lexicon is the same.

A document with no term in the band uses all its words, one without words its whole text as the
one term, and the fingerprint of the empty text is empty: 1 like another empty one, 0 like others.

To see each text beside the next document's, rows are dealt by ranges of doc_id; the first
document of a range is sent to the range before it too, and each range is sorted and streamed in
order. Only the ranges' bounds reach the driver, at most `RANGES` of them whatever the corpus.

Defined cases: null text is empty; of repeated doc_ids, texts order the rows; null doc_ids come
last; one document is its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_PUNCT, U, arrow_rows, claim, mix64, table, text_bytes, tidy, token_hashes, tokens

WIDE, SUBSETS = 8, 64
#: The band: terms in at least LEAST (and two) and at most MOST of all documents.
LEAST, MOST = 1e-4, 0.15
ROWS, RANGES = 4000, 20_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document number and hash of each document's distinct words, the documents' byte offsets, and how many there are."""
    raw, offsets = text_bytes(texts)
    starts, ends, doc = tokens(raw, offsets, IS_PUNCT)
    h = token_hashes(raw, starts, ends)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new], offsets, len(offsets) - 1


def _count(batches):
    """(term, n): in how many of a task's documents each term is."""
    claim(__name__)

    def merged(parts):
        h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        h, index = np.unique(h, return_inverse=True)
        return h, np.bincount(index, weights=n).astype(np.int64)

    def rows(h, n):
        for at in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000].view("i8")), pa.array(n[at : at + 100_000])], names=["term", "n"])

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        parts.append(np.unique(_terms(b.column(0))[1], return_counts=True))
        if len(parts) > 16:
            parts = [merged(parts)]
            if len(parts[0][0]) > 1_500_000:
                yield from rows(*parts[0])
                parts = []
    if parts:
        yield from rows(*merged(parts))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """The hashes of the terms in the band, sorted: at most (words a document) / least of them."""
    total = docs.count()
    held = docs.select(F.col(text).alias("text")).mapInArrow(tidy(_count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = held.where((F.col("n") >= max(2, least * total)) & (F.col("n") <= max(2, most * total))).select("term").toArrow()
    return np.sort(got["term"].to_numpy().view(U))


def _in_band(h: np.ndarray, band: np.ndarray) -> np.ndarray:
    if not len(band):
        return np.zeros(len(h), bool)
    return band[np.minimum(np.searchsorted(band, h), len(band) - 1)] == h


def _sequence_hashes(slot: np.ndarray, h: np.ndarray, slots: int) -> np.ndarray:
    """A hash of the terms of each slot in their order; terms come sorted within their slot. 0: no term."""
    order = np.argsort(slot, kind="stable")
    s, v = slot[order], h[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s)
    out = np.zeros(slots, U)
    np.add.at(out, s, mix64(v ^ mix64(rank.astype(U) + U(0x632BE59BD9B4E019))))
    used = np.zeros(slots, bool)
    used[s] = True
    out = mix64(out)
    out[~used] = 0
    return out


def _short(x: np.ndarray) -> np.ndarray:
    out = (x >> U(48)).astype(np.uint16)
    out[(out == 0) & (x != 0)] = 1
    return out


def prints(texts: pa.Array, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its level (-1: empty), its 64-bit hashes of the wide subsets, and 16-bit ones of the thin subsets at that level and the next."""
    doc, h, offsets, n = _terms(texts)
    keep = _in_band(h, band)
    some = np.zeros(n, bool)
    some[doc[keep]] = True
    keep |= ~some[doc]
    doc, h = doc[keep], h[keep]
    bare = np.flatnonzero((np.bincount(doc, minlength=n) == 0) & (offsets[1:] > offsets[:-1]))
    if len(bare):
        whole = [int.from_bytes(hashlib.blake2b(texts[int(i)].as_py().encode(), digest_size=8).digest(), "little") for i in bare]
        doc, h = np.append(doc, bare), np.append(h, np.array(whole, U))
    size = np.bincount(doc, minlength=n)
    level = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64), -1)
    wide = np.zeros((n, WIDE), U)
    for k in range(WIDE):
        in_subset = mix64(h + U((k * 97 + 13) * 0xD1B54A32D192ED03 & (2**64 - 1))) >= U((1 << 64) // 3 if k else 0)
        wide[:, k] = _sequence_hashes(doc[in_subset], h[in_subset], n)
    out = np.zeros((n, 2, SUBSETS), U)
    for k in (0, 1):
        depth = np.minimum(level[doc] + k, 40)
        slots, terms = [], []
        for r in range(SUBSETS):
            on = (r << depth) < SUBSETS
            if not on.any():
                break
            d, bits = doc[on], depth[on]
            v = mix64(h[on] + U((r * 41 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)) + bits.astype(U))
            part = (r << bits) + np.where(bits > 0, v >> (U(64) - np.maximum(bits, 1).astype(U)), U(0)).astype(np.int64)
            within = part < SUBSETS
            slots.append(d[within] * SUBSETS + part[within])
            terms.append(h[on][within])
        if slots:
            out[:, k] = _sequence_hashes(np.concatenate(slots), np.concatenate(terms), n * SUBSETS).reshape(n, SUBSETS)
    return level, wide, _short(out)


Prints = tuple[np.ndarray, np.ndarray, np.ndarray]


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Row by row, how alike two sets of prints are, 0 to 1."""
    (la, wa, ta), (lb, wb, tb) = a, b
    row, near = np.arange(len(la)), abs(la - lb) <= 1
    x, y = ta[row, np.clip(lb - la, 0, 1)], tb[row, np.clip(la - lb, 0, 1)]
    there = ((x != 0) | (y != 0)).sum(axis=1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    out = np.where(near & (there > 0), same / np.maximum(there, 1), 0.0)
    out[wa[:, 0] == wb[:, 0]] = 1.0
    out[(la < 0) | (lb < 0)] = 0.0
    out[(la < 0) & (lb < 0)] = 1.0
    return out


def text_of(level: np.ndarray, wide: np.ndarray, thin: np.ndarray) -> list[str]:
    """Fingerprints as text: the level, the wide hashes, the thin ones."""
    rows = zip(level.tolist(), wide.astype(">u8"), thin.astype(">u2"), strict=True)
    return ["" if k < 0 else f"{k:02x}{w.tobytes().hex()}{t.tobytes().hex()}" for k, w, t in rows]


def likeness_of(a: str, b: str) -> float:
    """likeness() of two fingerprint strings."""

    def back(s):
        if not s:
            return np.array([-1]), np.zeros((1, WIDE), U), np.zeros((1, 2, SUBSETS), np.uint16)
        data = bytes.fromhex(s[2:])
        return np.array([int(s[:2], 16)]), np.frombuffer(data, ">u8", WIDE).reshape(1, WIDE), np.frombuffer(data, ">u2", offset=8 * WIDE).reshape(1, 2, SUBSETS)

    return float(likeness(back(a), back(b))[0])


def _deal(bounds, heads):
    """Rows with their range, and once more with the range before if they are a range's first document."""

    def run(batches):
        claim(__name__)
        cuts, first, ranges = bounds.value, *heads.value
        before = {int(f): int(ranges[k - 1]) for k, f in enumerate(first)}
        for b in batches:
            ids = b.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            key = np.where(null, np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
            part = np.searchsorted(cuts, key, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(b), bool)), *b.columns], names=["part", "halo", "doc_id", "text"])
            again = np.flatnonzero(np.isin(key, first))
            if len(again):
                t = b.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([pa.array([before[int(k)] for k in key[again]], pa.int64()), pa.array(np.ones(len(again), bool)), *t.columns], names=["part", "halo", "doc_id", "text"])

    return run


def _firsts(bounds):
    def run(batches):
        claim(__name__)
        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            key = np.where(null, np.iinfo(np.int64).max, b.column(0).fill_null(0).to_numpy())
            part = np.searchsorted(bounds.value, key, side="right")
            order = np.lexsort((key, part))
            part, key = part[order], key[order]
            new = np.ones(len(part), bool)
            new[1:] = part[1:] != part[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(key[new])], names=["part", "first"])

    return run


def _fingerprint(lexicon):
    def rows(ids, texts, following):
        band = lexicon.value
        edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
        chain = pa.array([*texts, following[-1]], pa.large_string())
        own, changed = prints(chain, band), prints(pa.array(edited, pa.large_string()), band)
        mine, after = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(text_of(*mine)), pa.array(text_of(*changed)), pa.array(likeness(mine, changed)), pa.array(likeness(mine, after)),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )

    def run(batches):
        claim(__name__)
        ids, texts, size, part = [], [], 0, None  # consecutive documents of a range; the last waits for the one after it
        shut = False  # a halo row has ended the range
        for b in batches:
            for p, halo, i, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if p != part:
                    ids, texts, size, part, shut = [], [], 0, p, False
                if shut:
                    continue
                t = t or ""
                if halo:
                    shut = True
                    if ids:
                        yield rows(ids, texts, [*texts[1:], t])
                    ids, texts = [], []
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > 4_000_000 and len(ids) > 1:
                    yield rows(ids[:-1], texts[:-1], texts[1:])
                    ids, texts, size = ids[-1:], texts[-1:], len(t)

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its fingerprint, that of its edited text, and their likeness and that to the next document."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    band = spark.sparkContext.broadcast(lexicon(docs))
    parts = min(RANGES, max(1, -(-docs.count() // ROWS)))
    cuts = docs.stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = spark.sparkContext.broadcast(np.unique(np.array(cuts, np.float64).astype(np.int64)))
    first = docs.select("doc_id").mapInArrow(tidy(_firsts(bounds)), "part long, first long").groupBy("part").agg(F.min("first").alias("first")).orderBy("part").toArrow()
    heads = spark.sparkContext.broadcast((first["first"].to_numpy(), first["part"].to_numpy()))
    dealt = docs.mapInArrow(tidy(_deal(bounds, heads)), "part long, halo boolean, doc_id long, text string").repartition(parts, "part")
    dealt = dealt.sortWithinPartitions("part", "halo", F.col("doc_id").isNull(), "doc_id", "text")
    return dealt.mapInArrow(tidy(_fingerprint(band)), SCHEMA)


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
