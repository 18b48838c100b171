"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents. ``run`` chains them over the
documents table; intermediate tables go to the shared folder (``spark.checkpoint.dir``), and those of a
stage are deleted once its result is written.

Defined cases, in every stage: rows with a null id are documents like others and stay unless their text makes them
go; null and empty texts are equal to each other, have no shingles, and take no place in the mix, as they hold no
word; an empty table gives an empty table. Each stage's function states ties and repeated rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from ledgerlens.llm.shared import settled, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field does not call toxic; repeated rows are judged alike."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, that with the smallest id; rows that repeat id and text are one."""
    return exact_dedup.unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows that share an id go or stay together; rows without an id always stay.
    """
    return near_dedup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order that the curriculum takes them; every row has a schedule of its own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document stands in the packed sequences; repeated rows are packed each."""
    return packing.packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the trained filter; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(functools.partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return docs
