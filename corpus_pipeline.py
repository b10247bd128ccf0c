"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that the stages before it have kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelake.llm import classifier, common, ordered, packing, rules, suffixes


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps (operator 7): rows go, none change. A null text counts as empty, null metadata as a value; repeated rows share their verdict."""
    model = classifier.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), classifier.scores(model).alias("s"))
    return scored.filter("s.kept").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps (operator 4), however long. A null or empty text has too few words and goes; repeated rows share their verdict.

    A filter would be pushed below the measurements and have each of them computed again in every rule; a row of no or one
    document is made from the verdict instead.
    """
    return rules.judge(docs, rules.DEFAULT, row=True).select(F.inline(F.when(F.col("kept"), F.array("row"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class (operator 3): the one with the least doc_id.

    Null texts count as empty and are one class. Rows are told apart by doc_id and text: a null or repeated doc_id takes no
    other row along, and of rows equal in both one stays.
    """
    return ordered.survivors(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat (operator 2). A null text comes back empty; all copies of a passage go, the first included; null and repeated doc_ids do not matter."""
    kept = suffixes.remove_repeats(docs).select("row.*", F.col("kept").alias("text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes (operator 10)."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packed),
]
#: Classifier and packing cannot be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs, f"pipeline-{k}")
    return docs
