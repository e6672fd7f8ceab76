"""A training corpus from the documents table: quality rules, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes what its predecessor kept, as documents, and all but the last return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickflow.llm import line_dedup, mixing, packing, quality_rules, simhash
from wickflow.llm.common import read, shared_folder, word_count


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned rules reject; null texts have no words and go."""
    return quality_rules.judge(docs, read(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an equal or near line precedes; documents of which lines went go if no word is left.

    Those with a word left stay, however short: their lines may be the first copies of lines that others lost.
    """
    found = line_dedup.dedup_lines(docs)
    emptied = (F.col("kept_lines") < F.col("lines")) & (word_count(F.col("text")) == 0)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.where(~emptied).select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    Texts without words are one group; of rows that repeat an id and text, one stays.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at a source's cut with its first words; null sources are one."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_each),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Learned rules and token ids are beyond SQL; a test holds run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each result but the last is written as Parquet in the shared folder and read again.

    The folders stay, as the result reads the last of them; they can go with the session's other checkpoints.
    """
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
