"""The corpus pipeline: documents of good quality, without near copies, benchmark passages or secrets, packed for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder and reads it again as the
next one's docs. All but the last return the columns of documents. Rows are told apart by doc_id and
text, either of which may be null; rows equal in both count once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.llm import decontam, ngram_join, packing, quality, secrets
from lumaframe.llm.queries import WORD_VOCABULARY, table
from lumaframe.session import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the byte-level network, trained on labels' rows outside its held-out third, scores below 0.5."""
    net = quality.fit(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return quality.score_quality(docs, net, "_lf_score").where("_lf_score >= 0.5").select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a key _lf_key of doc_id and text, never null, and whether it is doc_id itself, which then is in no two rows."""
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()
    key = F.col("doc_id") if unique else F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    return docs.withColumn("_lf_key", key), unique


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id (a null is the largest) of each group linked by 0.75 Jaccard similarity of 5-word shingles."""
    keyed, unique = _keyed(docs)
    groups = ngram_join.jaccard_components(keyed.select(F.col("_lf_key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_lf_key")
    if unique:
        return keyed.join(groups.where("_lf_key = component_id").select("_lf_key"), "_lf_key", "left_semi").select(*docs.columns)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_lf_key"))
    stay = keyed.select("_lf_key", "doc_id").join(groups.select("_lf_key", "component_id").distinct(), "_lf_key").groupBy("component_id").agg(least.alias("x")).select("x._lf_key")
    return keyed.join(stay, "_lf_key", "left_semi").dropDuplicates(["_lf_key", "doc_id", "text"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain three quarters of a benchmark item's shingles."""
    keyed, _ = _keyed(docs)
    found = decontam.contained_items(keyed.select(F.col("_lf_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_lf_key")).distinct()
    return keyed.join(found, "_lf_key", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents packed into sequences of 4096."""
    return packing.best_fit_packing(docs, public_tokenizers.path(WORD_VOCABULARY), 4096, 1)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]
#: A trained network and a tokenizer are no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
