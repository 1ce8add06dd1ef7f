"""The corpus pipeline: documents without toxic ones, near copies, repeated passages and secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, in the columns of
documents; the last returns the packed pieces. run() writes each stage's result as Parquet and reads
it again, so a lost executor repeats no earlier stage. Every stage keeps rows of null ids, repeated rows
and columns of any names; null and empty texts count as empty and stay as they are; very long texts are
worked on whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinname.llm import near_duplicates, packing, queries, repeats, secrets, toxicity
from kinname.sources.shared import remove, scratch, shared_dir


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier chain, trained on the labelled ones, rejects.

    Without labels nothing is rejected. Null and empty texts are judged as texts without known words.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels, queries.toxicity_categories()))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near copies: five words, similarity 0.8.

    Null and empty texts are one group, a null id comes after all others, and of equal rows one stays.
    """
    return near_duplicates.without_near_duplicates(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has; documents of which nothing is left go.

    Null and empty texts and those under 50 words stay as they are.
    """
    return repeats.without_repeats(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; all rows stay, null texts stay null."""
    return secrets.without_secrets(docs, secrets.train(secrets.made_findings()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a null or empty text is its separator alone."""
    return packing.pack_documents(docs, queries._path("word_bpe_49k.json"))


STAGES = [("toxicity", remove_toxic), ("minhash_near_dedup", remove_near_duplicates), ("suffix_array_dedup", remove_repeats), ("secret_scans", remove_secrets), ("best_fit_packing", pack)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    before = None
    for name, stage in STAGES:
        with scratch(spark):  # what a stage wrote for itself goes with it, and so does what it read
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
