"""A corpus in five stages: toxic documents go, boilerplate lines go, of near-duplicates one stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the first four the columns of
`documents`, the last the packed pieces. Between stages `run` writes Parquet into the shared folder
and reads it back, so a stage never recomputes its predecessors and survives lost executors.

Defined cases: null texts pass all filters and stay null until packing, where they are empty; null
doc_ids are never dropped as duplicates; rows with the same doc_id share their fate; `n_chars`
follows the text where a stage changes it; extra columns pass through to the fourth stage; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import line_dedup, ngram_jaccard, packing, secrets, toxicity
from rasterloom.llm.common import WRITTEN, drop_written, table, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of sf_dir, predicts to be toxic go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many of a source's documents go; a document stays even if no line does."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}  # columns of the input, not the counts
    out = line_dedup.drop_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in own.items()})
    return _counted(out.select(*docs.columns))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links on word shingles join, the one with the smallest doc_id stays."""
    comp = ngram_jaccard.similarity_components(docs)
    gone = comp.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; all documents stay."""
    return _counted(secrets.redact(docs, secrets.model(docs)))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", one_of_each),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: Classifiers, components and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, [p for p in WRITTEN[mark:] if p != WRITTEN[-1]])  # the stage's own tables and its input
    return STAGES[-1][1](spark, docs, sf_dir)
