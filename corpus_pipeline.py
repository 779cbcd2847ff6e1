"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Documents that the quality classifier rejects go; lines that an earlier document holds in the same place go from later ones; one
document of each near-duplicate group stays; sources are repeated to their target weights; the last stage encodes what is left and
returns doc_id, copy (rows of one document are numbered by the mixing stage's order), n_ids, ids and whether they decode to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import line_dedup, minhash, mixing, pieces, quality_model
from barloom.llm.frames import saved
from barloom.llm.queries import PIECES, table, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labels of ``sf_dir`` and the texts of ``docs``; rows with a null doc_id are kept, as no label names them."""
    scores = quality_model.quality_scores(docs, table(spark, sf_dir, "labels"))
    bad = scores.filter("predicted = 0").groupBy("doc_id").agg(F.count("*")).select(F.col("doc_id").alias("__bad"))
    return docs.join(bad, F.col("doc_id") == F.col("__bad"), "left_anti")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.coded(docs.select("doc_id", "source", "text"), tokenizer(PIECES)).select("doc_id", "source", "n_ids", "ids_crc32", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality), ("line_dedup", without_repeated_lines), ("minhash_near_dedup", one_of_each_group), ("mixing", mixed), ("sentencepiece", encoded)]
#: Fitted models, alignment and shingle sketches are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
