"""The corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents; where a stage changes texts, n_chars follows. Null ids, repeated rows and further columns, whatever their names, go
through; empty tables give empty tables. Empty texts go in the first stage. Very long texts are read whole by every stage, and
packed in pieces. Of equal texts the one with the smallest id stays, and of rows that are equal too, all: they are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import decontaminate, language_id, line_dedup, packing, simhash
from doclake.llm.common import fresh, stored


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


#: Documents are judged by the languages that documents of other folds make.
FOLDS = 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no language that other documents' labels name, go."""
    fold = fresh(docs, "fold")
    own = docs.withColumn(fold, language_id.fold_of(docs["doc_id"], FOLDS).cast("int"))
    learned = language_id.without_own(language_id.fold_profiles(own, own[fold]), FOLDS)
    pred = fresh(own, "lang_pred")
    score = fresh(own.withColumn(pred, F.lit("")), "score")
    found = language_id.predict(own, learned, fold=fold)
    return found.where((F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= language_id.MIN_SCORE)).select(*docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only."""
    return _measured(line_dedup.dedup_lines(docs), docs.columns)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark passages are cut; documents made of them almost wholly go."""
    return _measured(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row a piece."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("line dedup", unique_lines),
    ("SimHash near-dedup", unique_documents),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: Hashing, bundling and packing are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
