"""The corpus pipeline: clean, de-duplicate, decontaminate, mix and tokenise ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.  The result is the
token files' digest, a row for every training copy of a document.

The token files are in ascending doc_id order, so the curriculum's order ends with
the mixing stage's own table: here it decides how many copies a document gets.

Defined cases: a null or wordless text is scored by the toxicity model's bias, is
alike to nothing and hits nothing, and goes in the mix, which takes no document
without words; a row without a doc_id is judged by its text like any other and is
its own group; rows that share a doc_id are one document of which one row stays (the
smallest hash of a text among equals); ties and repeated rows are as in the stages'
own modules; a stage without rows gives none, and an empty table an empty result;
further columns of ``documents``, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontaminate, mixing, neardup, tokens, toxicity
from rasterloom.llm.common import drop, scratch, stage, table
from rasterloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.remove(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays."""
    return neardup.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a ten-word window with the benchmark go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy the mix takes, in training order."""
    return mixing.training_order(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens and ids_crc32 of every copy."""
    return tokens.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]

#: SQL can express neither the trained model nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        # What a stage wrote, its input included, goes once the next one's input is written.
        with scratch(spark) as kept:
            before, docs = docs, stage(apply(spark, docs, sf_dir), name)
            kept.append(docs)
        drop(before)
    tokens_read = STAGES[-1][1](spark, docs, sf_dir)
    drop(docs)
    return tokens_read
