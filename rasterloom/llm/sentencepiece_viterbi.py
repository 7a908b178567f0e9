"""SentencePiece encoding by streaming Viterbi, and decoding.

The segmentation of the highest summed piece score is sought over the pieces of a SentencePiece
model file; of equal ones, that with the longer last piece. A character that no piece covers costs
10 below the lowest score and becomes byte ids. The search streams: scores are kept for one
maximum piece length only, back-pointers for the part not yet committed, and as soon as the paths
to all boundaries that can still be extended meet in one boundary, the ids up to it are final and
their state is dropped.

Where no piece contains white space within it, each word start is such a boundary whatever the
text, so a word's ids do not depend on its neighbours. Workers therefore remember the ids of
short words they have met (bounded, cleared when full); long runs are streamed.

Defined cases: null text has null ids and counts; empty text has none; decoding gives back the
text but for U+2581, which the format uses for the space; invalid byte sequences decode to U+FFFD;
repeated rows, ties in doc_id and extra columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cache, claim, table

SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MODELS: dict[str, Pieces] = cache()


class Pieces:
    """The pieces of a model file as a trie of {character: (children, id or -1, score)}."""

    def __init__(self, path: str, keep: int = 1_000_000, longest: int = 48):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.trie: dict = {}
        self.byte_ids, self.keep, self.longest, self.known = [0] * 256, keep, longest, {}
        self.surface = [b""] * len(model.pieces)
        lowest, self.length, self.inner_space, unknown = 0.0, 1, False, 0
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (1, 4):
                children = self.trie
                for c in p.piece[:-1]:
                    children = children.setdefault(c, ({}, -1, 0.0))[0]
                children[p.piece[-1]] = (children.get(p.piece[-1], ({},))[0], i, p.score)
                lowest, self.length = min(lowest, p.score), max(self.length, len(p.piece))
                self.inner_space |= SPACE in p.piece.lstrip(SPACE)
                self.surface[i] = p.piece.encode()
            elif p.type == 2:
                unknown = i
        self.unknown_score = lowest - 10
        if not model.trainer_spec.byte_fallback:
            self.byte_ids = [unknown] * 256
        self.prefix = model.normalizer_spec.add_dummy_prefix

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def word(self, run: str) -> bytes:
        found = self.known.get(run)
        if found is None:
            found = np.array([k for ids in stream(self, (run,)) for k in ids], "<u4").tobytes()
            if len(run) <= self.longest:
                if len(self.known) >= self.keep:
                    self.known.clear()
                self.known[run] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit bytes."""
        if not text:
            return b""
        escaped = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.inner_space:
            return self.word(escaped)
        return b"".join(map(self.word, _RUNS.findall(escaped)))

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def stream(p: Pieces, chunks, peak: list[int] | None = None):
    """Lists of ids that have become final, for a text that comes in chunks. peak[0]: the most boundaries held at once.

    Boundaries are counted from the last commit. best: their score; start and piece: the last
    piece of the best path to them (None and -1: byte ids). Only boundaries up to one maximum
    piece length ahead of `at` can be reached and still change.
    """
    length, root, unknown = p.length, p.trie, p.unknown_score
    text, at, far = "", 0, 0
    best, start, piece = [0.0], [0], [0]

    def commit(end: int) -> list[int]:
        ids, j = [], end
        while j:
            i = start[j]
            if piece[j] >= 0:
                ids.append(piece[j])
            else:
                ids.extend(p.byte_ids[b] for b in reversed(text[i:j].encode("utf-8", "surrogatepass")))
            j = i
        ids.reverse()
        return ids

    def meeting() -> int:
        """The last boundary on the paths to all boundaries that can still be extended; 0 if they meet only at the start."""
        live = {j for j in range(at, far + 1) if best[j] is not None}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(start[last])
        return live.pop()

    for chunk in (*chunks, None):
        text += chunk or ""
        n = len(text)
        stop = n if chunk is None else n - length + 1  # a boundary is extended when its longest piece lies in the text so far
        while at < stop:
            score = best[at]
            if score is not None:
                more = at + length + 1 - len(best)
                if more > 0:
                    best += [None] * more
                    start += [0] * more
                    piece += [0] * more
                    if peak and len(best) > peak[0]:
                        peak[0] = len(best)
                children, j, single = root, at, False
                for c in text[at : at + length]:
                    node = children.get(c)
                    if node is None:
                        break
                    children, k, s = node
                    j += 1
                    if k >= 0:
                        s += score
                        was = best[j]
                        if was is None or s > was:
                            best[j], start[j], piece[j] = s, at, k
                            if j > far:
                                far = j
                        if j == at + 1:
                            single = True
                if not single:
                    j = at + 1
                    if best[j] is None or score + unknown > best[j]:
                        best[j], start[j], piece[j] = score + unknown, at, -1
                        if j > far:
                            far = j
            at += 1
            if at >= length and at < n:
                end = at if far == at else meeting() if at >= 4 * length and at % length == 0 else 0
                if end:
                    yield commit(end)
                    base = best[end]
                    text, at, far, n, stop = text[end:], at - end, far - end, n - end, stop - end
                    best = [None if x is None else x - base for x in best[end:]]
                    start, piece = [x - end for x in start[end:]], piece[end:]
                    start[0] = 0
        if chunk is None and n:
            yield commit(n)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids of its text (array of int, null for null text)."""

    def run(batches):
        claim(__name__)
        pieces = Pieces.of(model)
        for b in batches:
            ids = [None if t is None else np.frombuffer(pieces.encode(t), "<u4").astype("i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids, as encode() gives them."""

    def run(batches):
        claim(__name__)
        pieces = Pieces.of(model)
        for b in batches:
            texts = [None if x is None else pieces.decode(np.array(x, "i4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def digest(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: counts, checksum of the ids, digest of the decoded text, and whether it is the text."""

    def run(batches):
        claim(__name__)
        pieces = Pieces.of(model)
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t is None:
                    rows.append((doc, None, None, None, None, None))
                    continue
                data = pieces.encode(t)
                back = pieces.decode(np.frombuffer(data, "<u4"))
                rows.append((doc, len(t), len(data) // 4, zlib.crc32(data), hashlib.sha256(back.encode()).hexdigest(), back == t))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    arrow_rows(docs.sparkSession)
    schema = "doc_id long, n_chars long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
