"""Corpus pipeline over ``documents``: every stage applies one operator of ``earshot.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; ``docs`` is a written table.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import minhash, packing, pii, suffix_dedup, toxicity
from earshot.llm.queries.packing import PATTERN, RANKS
from earshot.llm.store import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a repeated string that is cut: 50 short words.
REPEATED_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade is one half or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).where("not toxic").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8); texts without words all stay."""
    return minhash.first_of_each(docs.select(COLUMNS), shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEATED_BYTES`` that stand in several places are cut everywhere; rows stay, if with less text."""
    out = suffix_dedup.remove_repeats(docs.select(COLUMNS), window=REPEATED_BYTES, as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    masked = pii.masked(pii.personal_spans(docs.select(COLUMNS)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1,024 with their ids."""
    return packing.pack(docs, RANKS, PATTERN, length=1024)


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("suffix_dedup", cut_repeats), ("pii", mask_personal_data),
    ("packing", pack),
]
#: Training, near-duplicate components and token ids are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed corpus: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
