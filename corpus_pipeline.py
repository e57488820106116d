"""A corpus pipeline over ``documents``: quality filter, near-duplicate removal, PII sanitisation, sequence packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever they are named: rows travel as one
column beside the stage's own. ``run`` writes each stage's result to the shared checkpoint folder and goes on from there. Null and empty texts are scored by the
bias of the classifier, link with nothing, hold nothing to sanitise and are packed as an end id; texts of any length stay whole; of rows that are equal in id and text one stays, as of
near copies the one of least id, ties by a hash of the text; rows of equal score fare alike; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from docspark.llm import ngram_join, packing, pii, quality
from docspark.llm.common import cut, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier scores at the threshold or above."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = "_score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return quality.score(docs, model, out=name).filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of similar documents: that of the least id."""
    return ngram_join.one_of_each(docs, cut(ngram_join.similar(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that disclose it; ``n_chars``, where the table has it, follows the new text."""
    made = pii.redact(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("pii", pii_sanitisation),
    ("packing", sequence_packing),
]

#: The classifier, the tokenizer and the packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
