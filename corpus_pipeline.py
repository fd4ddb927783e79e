"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing, SentencePiece encoding.

Each stage reads all that its predecessor kept, as a Parquet table in the shared folder, and returns the columns
of `documents`; the last adds n_tokens, piece_ids and round_trip. A stage's table is deleted once the next one's is
written; the last one's is the result's and stays.

Defined results: null and empty texts go in the first stage, as no language is determined for them, and with them texts
without a letter; rows without an identifier are kept or dropped by their text as all others are, and rows that repeat
identifier and text stay once; of texts as near as each other the one with the smallest identifier stays; an empty table
gives no rows and the same columns; texts of any length are read whole; a column of `docs` that is none of a stage's own
is carried along, and one named as a result of the last stage is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import exact_dedup, langid, mixing, neardup, pieces
from roadloom.llm.common import drop_table, table_path

#: A document is rejected when no language is determined, or the best one holds less than this share of its bytes.
MIN_LANG_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network determines; it learns from the stage's own labelled rows."""
    found = langid.identify(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANG_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.Deduped(docs, keep="largest").keep_rows()


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.NearDup(docs).keep_rows()


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return pieces.encode(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = table_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_table(spark, before)
        before = path
    return docs
