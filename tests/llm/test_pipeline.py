"""The pipeline on a small corpus, each stage against what it was given."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def corpus(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(900)}"
    rows, labels = [], []
    for i in range(420):
        bad = i % 7 == 3
        lines = [" ".join([*(word() for _ in range(30)), *(["vilest rotter"] if bad else []), word()]) for _ in range(2)]
        rows.append((i, "\n".join((["Home | About"] if i % 4 else []) + lines), "en", "host" if i < 414 else "few", 0))
        labels.append((i, 1, int(bad)))
    text = {r[0]: r[1] for r in rows}
    near = text[13].split(" ")
    near[5] = "changed"
    rows += [(500, text[13], "en", "host", 0), (501, " ".join(near), "en", "host", 0), (502, 'a token = "3f76bb46f51625a07193ae74d1cc485f188b9b5d" b', "en", "few", 0), (503, None, None, None, None), (504, "", "en", "host", 0), (None, "without an id at all", "en", "few", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as n_lines").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return {r[0]: r for r in rows}


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i in range(420) if i % 7 == 3}
    gone = set(rows) - set(seen["toxicity"])
    assert gone <= toxic and len(gone) > 0.9 * len(toxic)
    lines = seen["line_dedup"]
    assert set(lines) == set(seen["toxicity"]) and not any(r.text and "Home | About" in r.text for r in lines.values() if r.source in ("host", "few"))
    assert all(r.text is None or r.n_chars == len(r.text) for r in lines.values())
    assert set(lines) - set(seen["ngram_jaccard"]) == {500, 501} - gone
    assert {r.n_lines for r in lines.values()} == {1}
    masked = seen["secret_scan"]
    assert masked[502].text == 'a token = "[SECRET]" b' and set(masked) == set(seen["ngram_jaccard"]) and masked[503].text is None
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed) == Counter(masked.keys()) and max(r.offset + r.length for r in packed) <= 2048
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(again) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_line_stage_ratio(spark):
    """A line on 8 % of a source's documents goes, one on 4 % stays; in a small source two documents are too few."""
    rows = [(i, "\n".join([*(["site line"] if i % 12 == 0 else []), *(["ordinary"] if i % 25 == 0 else []), f"own {i}"]), "big") for i in range(100)]
    rows += [(200 + i, "\n".join([*(["pair"] if i < 2 else []), *(["three"] if i < 3 else []), f"own {i}"]), "small") for i in range(12)]
    out = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    got = Counter(x for r in out.collect() for x in r.text.split("\n"))
    assert got["site line"] == 0 and got["ordinary"] == 4 and got["pair"] == 2 and got["three"] == 0 and got["own 7"] == 2


def test_empty_corpus(spark, tmp_path):
    corpus(spark, tmp_path)
    empty = tmp_path / "empty"
    for t in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).where("false").write.parquet(str(empty / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
