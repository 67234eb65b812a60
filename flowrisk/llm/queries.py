"""One query per operator, over its whole table with production parameters, and the SQL that checks it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowrisk.llm import decontamination, embedding_dedup, simhash, spelling, suffix_tree
from flowrisk.llm.common import table
from flowrisk.llm.language import language
from flowrisk.llm.mixing import mix
from flowrisk.llm.packing import pack_documents
from flowrisk.llm.prefix_trie import conversation_trie
from flowrisk.llm.quality import quality
from flowrisk.llm.secret_scan import secrets
from flowrisk.llm.sharding import shard_rows
from flowrisk.llm.token_counts import token_counts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digests(found)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_packing, op3_simhash, op4_language, op5_mixing, op6_secret_scan,
                                  op7_quality_rules, op8_suffix_tree, op9_sharding, op10_embedding_dedup, op11_spelling, op12_decontamination,
                                  op13_conversation_trie)}
ORACLE: dict[str, str] = {}

ORACLE["op7_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
places AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeated, range(0, 5) AS r(k) GROUP BY rid),
base AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(places.n, 0) AS n_repeat_words
  FROM d LEFT JOIN places USING (rid)),
counted AS (
  SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR n_dup_lines * 2 > len(l) OR len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) * 10 > 3 * n_words
            OR len(regexp_extract_all(t, '\p{Lu}')) * 10 > 4 * word_chars
            OR len(regexp_extract_all(t, '\p{L}')) * 10 < 6 * word_chars
            OR len(list_filter(w, lambda x: regexp_matches(x, '!!$'))) * 10 > 3 * n_words
            OR len(list_filter(w, lambda x: x = '|')) * 10 > n_words) AS kept
FROM counted
"""
