"""Cleaning and encoding of a corpus: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerows.llm import decontaminate, pii, piece_bpe, simhash, toxicity
from pagerows.llm.base import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels of held-out ids teach nothing."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon, keep=docs.columns, name="__score")
    return scored.where(F.col("__score") < 0.5).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one document stays, once: the one with the least id, and of several texts with that
    id the one with the least hash. Texts of other groups that share the id stay; so do all rows with a null id."""
    marked = docs.withColumn("__hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("__null", F.col("text").isNull())
    groups = simhash.grouped(marked, ["doc_id", "__hash", "__null"]).where("doc_id = component_id")
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", "__hash", "__null")).alias("k")).select("k.*")
    named = marked.join(kept, ["doc_id", "__hash", "__null"], "left_semi").dropDuplicates(["doc_id", "__hash", "__null"])
    return named.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and wordless texts are clean. Columns pass as they are, whatever their names."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col("text").alias("__text"))
    found = decontaminate.contamination(whole, table(spark, sf_dir, "benchmark"), "__text", ["__doc"])
    return found.where(~F.col("contaminated")).select("__doc.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts change, rows don't."""
    return pii.redact(docs, pii.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of them and of what they decode to; other columns go. Null and empty texts
    have the end id alone."""
    return piece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), full=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode),
]

#: SQL expresses neither the learned stages nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
