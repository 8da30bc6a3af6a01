"""A training corpus from ``documents`` in five stages.

Each stage takes the documents that the one before it kept, with their own columns, and every decision takes
effect: rejected documents go, one document of each near-duplicate group stays, secrets are masked in the
text, and the last stage gives packed pieces instead of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm import chosen_path, packing, quality, secret_scan, toxicity
from tallyframe.llm.common import stored
from tallyframe.llm.queries import table, tokenizer_path

#: SQL has neither the compression, the similarity join nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores learn from the labelled rows of the whole table but the held-out ones, so they hang on no earlier stage."""
    labelled = table(spark, sf_dir, "documents").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(labelled, table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", good_quality),
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("secret scans", masked_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
