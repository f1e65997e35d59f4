"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumaframe.llm import ann, chat, decontam, langid, ngram_join, packing, quality, secrets, store, suffix

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), 4096, 1)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), 20, 20)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), 2)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(table(spark, sf_dir, "documents"), 200)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_packing, op3_neighbours, op4_decontamination, op5_secrets, op6_chat, op7_token_store, op8_ngram_jaccard, op9_suffix_dedup, op10_language)
}

_WORDS = r"""
SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
FROM {table}"""
_SHINGLES = """
SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s
FROM ({words}) WHERE len(w) > 0"""


def _shingles(key: str, name: str) -> str:
    return _SHINGLES.format(key=key, words=_WORDS.format(key=key, table=name))


ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS ({_shingles("doc_id", "documents")}), b AS ({_shingles("item_id", "benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item::DOUBLE AS containment
FROM hit JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item""",
    "op8_ngram_jaccard": f"""
WITH RECURSIVE d AS MATERIALIZED ({_shingles("doc_id", "documents")}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.r, documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m USING (doc_id)""",
}
