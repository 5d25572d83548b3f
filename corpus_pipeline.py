"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, packing.

Edge cases: null and empty texts fail the quality rules and go. Very long texts are taken whole. Rows that repeat a key and text become one; rows of one key with
different texts stay apart; a null key stays unless its text is a near copy of a kept one. Null languages and sources are groups of their own. Of equal or near texts the smallest key
stays. Extra columns, whatever their names, go through all stages but the last. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import nearcopies, packing, quality, secrets
from kmerloom.llm.store import saved, table
from kmerloom.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.rules(docs, "__quality").where("__quality.kept").select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    ship(spark)
    return nearcopies.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets replaced."""
    ship(spark)
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Packing by tokenizer ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
