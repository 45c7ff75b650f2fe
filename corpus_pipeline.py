"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, SentencePiece ids.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import exact_dedup, language_id, mixing, near_dedup, piece_dropout
from lexiloom.llm.common import materialize, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; rejected ones go (no text or letter, or a low score).

    Null and empty texts go; a null doc_id or lang does not matter; repeated rows stay or go together.
    """
    return language_id.known_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space normalised): the smallest doc_id.

    Null texts count as empty ones; rows without a doc_id stay only where their group has no other; of rows tied on the
    doc_id the one with the least hash of its text stays, then the first by the other columns.
    """
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 or more: the smallest doc_id.

    Texts without words stand alone, equal rows among them stay once; null doc_ids come last, ties are broken by the text's
    hash, then by the other columns.
    """
    return near_dedup.one_of_each(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order: sources at their target weights, a document up to twice.

    A null source is a source of its own; texts without words are not used; tied rows keep a fixed order.
    """
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and ids of each document's text; a null or empty text has no ids, a null doc_id stays null."""
    return piece_dropout.encode(docs, piece_dropout.default_path())


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("piece_dropout", tokenize),
]

#: SQL can express neither the trained classifier nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
