"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame, which is
written as Parquet and reread as the next one's documents. All but the last return the columns of the input.
An empty table passes through all stages; null texts are rejected by the quality rules (they have no words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm.decontaminate import drop_contaminated
from fleetgauge.llm.packing import pack, token_pieces
from fleetgauge.llm.quality import keep_good
from fleetgauge.llm.queries import tokenizer_file
from fleetgauge.llm.simhash import drop_near_duplicates
from fleetgauge.llm.storage import session, stored, table

CAPACITY, END_ID = 4096, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    session(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (3-word shingles, 2 bits)."""
    session(spark)
    return drop_near_duplicates(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(session(spark), sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    session(spark)
    return pack(token_pieces(docs, tokenizer_file("word_bpe_49k.json"), END_ID, CAPACITY), CAPACITY)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The stages hash, retrieve and pack in ways SQL cannot state; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``."""
    docs = table(session(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
