"""One query per operator over its whole table, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, language, licenses, line_dedup, manifest, minhash, mixing, pieces, quality_model, quality_rules, spelling, token_files, toxicity

PIECES, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"

def tokenizer(name: str) -> str:
    """The path of a public vocabulary file, which every machine of the cluster has."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules", quality_rules.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_embedding_near_dedup", embeddings.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_minhash_near_dedup", minhash.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query("op6_mixing", mixing.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to: n_ids, crc32 of the ids and whether the text came back."""
    docs = pieces.coded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(PIECES))
    return docs.select("doc_id", "n_ids", "ids_crc32", "round_trip")


@query("op10_license_scan", licenses.sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", manifest.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, and what they give for rows of which the lines of every other document were run together."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    tampered = manifest.leaf_digest(*[text if c == "text" else F.col(c) for c in manifest.COLUMNS])
    m = manifest.manifest(docs, extra={"tampered": tampered})
    root = F.lit(m.root).cast("string")
    out = m.proofs().withColumn("folded_root", manifest.folded(F.col("tampered"), F.col("path")))
    return out.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == root).alias("verified"))


@query("op12_spelling_variants", spelling.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))
