"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes every stage's
rows to the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from cairn.llm.common import materialize, table
from cairn.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a learned language: null texts, texts without a letter, and what the network takes for none of them."""
    return language_id.keep_languages(docs.select(*COLUMNS), language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring template lines inside documents; keeps every document."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class, and no copy whose lines have all gone to the first one."""
    return near_dedup.keep_representatives(docs.select(*COLUMNS).where(F.col("text").rlike(r"\S"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the kept documents into training sequences of 2048 tokens."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing_)]

#: A recurrent network and alignments are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
