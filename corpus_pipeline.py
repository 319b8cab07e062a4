"""A corpus pipeline of five of the operators: documents in, packed training sequences out.

Stages run one after another; each works on what the one before kept, written as Parquet in the shared folder and read
again, so a lost executor costs one stage's tasks at most.

Defined cases, for every stage: a null or empty text is a document like any other (the classifier scores it, it is no
near duplicate of anything, holds no repeat and no item, and is packed as its end token alone); repeated rows are judged
one by one, and only the near-duplicate stage drops all but one of them; rows with a null id are kept or dropped by their
text alone; a very long text is handled whole; an empty table gives an empty result; all columns of documents come out as
they went in, whatever their names, but for `text` and `n_chars` where repeats were taken out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import decontamination, jaccard_join, packing, quality_classifier, run_length_index
from cellarium.llm.common import materialize, set_apart


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels of the training fold, does not reject: a score of 0.5, as where there are no labels, is kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality_classifier.training_fold())
    narrow, restore = set_apart(docs, "doc_id", "text")
    model = quality_classifier.fit(docs.select("doc_id", "text").where(quality_classifier.training_fold()), labels)
    return restore(quality_classifier.score(narrow, model).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (the least id; of equal ids the least text hash), and all without words."""
    return jaccard_join.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 200 bytes or more that are found elsewhere."""
    left = run_length_index.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item occurs in."""
    narrow, restore = set_apart(docs, "doc_id", "text")
    return restore(decontamination.decontaminate(narrow, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each with its sequence and offset."""
    return packing.pack(materialize(packing.tokenized_pieces(docs, packing.tokenizer_path()), "pieces"))


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        now = materialize(stage(spark, now, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, now, sf_dir)
