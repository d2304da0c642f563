"""A corpus from raw documents to packed sequences: language, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, langid, neardup, packing, secrets
from granary.llm.common import clean_up, made, stored, table
from granary.llm.queries import tokenizer_path

#: Below this mean posterior of its best language a document counts as being in none.
MIN_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that no learned language explains; the model learns from docs. Where no
    row has both a text and a lang nothing can be learned, and all rows stay."""
    return langid.accepted(docs, langid.train(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of shingle similarity 0.8 or more (five words) stays: that of the least id."""
    return neardup.deduplicated(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of texts; documents that are mostly benchmark text go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a label; every document stays."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, of power-of-two length, with its ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("packing", packed),
]

#: SQL can express neither the trained language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the last is returned unwritten. What a
    stage has left in the folder is deleted once its rows are written, and so are the rows of the stage before."""
    docs, since = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        clean_up(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
