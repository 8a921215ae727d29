"""A training-data pipeline: documents go through the stages in order, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontaminate, pieces, repetition, secrets, simhash
from leafmill.llm.common import forget, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves go. Null, empty and wordless texts stay; rows are judged one by one, so repeated
    rows and ties share a verdict; long texts are judged whole; an empty table gives an empty one; further columns stay,
    whatever their names."""
    return repetition.keep_unrepetitive(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id, a null one last, and by a hash of
    the row among equal ones. Of repeated rows one stays. Null, empty and wordless texts all stay; an empty table gives an
    empty one; further columns stay, whatever their names."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of test items go. Null and empty texts stay, as does everything where the benchmark is
    empty or has only null texts; rows are judged one by one; an empty table gives an empty one; further columns stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every row stays, repeated ones too. Null and empty texts stay as they are; an
    empty table gives an empty one (nothing to train on); further columns stay."""
    return secrets.redact(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids, repeated rows too: null for a null text, none for an empty one. Null doc_ids are carried; an empty
    table gives an empty one; further columns are left out, whatever their names."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("piece_ids", piece_ids),
]

#: Suffix arrays, trie joins and Viterbi decoding have no counterpart in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage for the documents in sf_dir. A stage's table goes as soon as the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            forget(before)
        before = docs
    return docs
