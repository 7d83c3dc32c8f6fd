"""A training corpus from raw documents, stage by stage.

Every stage takes what its predecessor kept, is written as Parquet in the
shared folder and read again. All but the last return the columns of the
documents. There is no SQL for the rows of `run`: the first stage is a fitted
model and the last a tokenizer, so tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontam, langid, lines, minhash, packing
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.tables import written
from tidemark.session import ship_package

# A document stays if the mean posterior of its language is at least this.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those of no clear language."""
    ship_package(spark)
    d = langid.identify(docs)
    return d.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; a document left without text goes."""
    ship_package(spark)
    kept = lines.dedup_lines(docs).select("row.*", "kept_text", "n_dropped")
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    d = kept.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return d.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8."""
    ship_package(spark)
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    nameless = docs.filter(F.col("doc_id").isNull())
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]).union(nameless)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which one word in twenty or more lies in benchmark passages."""
    ship_package(spark)
    d = decontam.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return d.filter(~decontam.contaminated()).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row per piece."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup),
          ("decontaminate", decontaminate), ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
