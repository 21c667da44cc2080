"""Queries of this subpackage for the driver: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, host_rules, licences, pii, preferences, prefix_trie, toxicity, vector_codes
from .common import table
from .exact_dedup import exact_groups
from .host_rules import host_verdicts
from .packing import pack
from .pitman_yor import text_scores
from .quality_model import quality_scores
from .simhash import as_hex, near_duplicates


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_of(base, i).alias(f"n_{kind.name}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chosen, and their versions with answers cut short as rejected."""
    chosen = preferences.stored_turns(table(spark, sf_dir, "conversations"))
    return preferences.paired(preferences.preference_messages(chosen, preferences.cut_short(chosen)))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(table(spark, sf_dir, "documents"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str, tokenizer_file: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_file)


def packed(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    pieces = pack(docs, tokenizer_file, public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_verdicts(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    tokens = bpe.encode(table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)
    text = bpe.decode(tokens, rank_file, public_tokenizers.PATTERN)
    return text.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op8_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", as_hex().alias("fingerprint"), "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_weak_pii, op2_preference_format, op3_pitman_yor, op4_mixture_packing, op5_quality_discriminant, op6_host_rules, op7_byte_bpe, op8_licence_sentences, op9_simhash_near_dedup,
    op10_exact_dedup, op11_toxicity, op12_prefix_trie, op13_vector_codes,
)}

ORACLE_SQL = {
    "op10_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
    """,
    "op2_preference_format": r"""
        WITH c AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
        t AS (SELECT pair_id, turn, role, text, CASE WHEN role = 'assistant' AND 2 * turn >= last AND contains(text, '.') THEN split_part(text, '.', 1) || '.' ELSE text END AS cut FROM c),
        p AS (SELECT *, coalesce(turn < min(CASE WHEN text <> cut THEN turn END) OVER (PARTITION BY pair_id), true) AS shared FROM t),
        m AS (SELECT pair_id, 'prompt' AS part, turn, role, text FROM p WHERE shared
            UNION ALL SELECT pair_id, 'chosen', turn, role, text FROM p WHERE NOT shared UNION ALL SELECT pair_id, 'rejected', turn, role, cut FROM p WHERE NOT shared),
        r AS (SELECT pair_id, part, turn, role, '<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS rendered FROM m),
        o AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
        SELECT pair_id, CAST(0 AS BIGINT) AS chunk, coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt, coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen,
            coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
            coalesce(string_agg((before + 13 + length(role)) || ':' || (before + length(rendered) - 1), ',' ORDER BY turn) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
            coalesce(string_agg((before + 13 + length(role)) || ':' || (before + length(rendered) - 1), ',' ORDER BY turn) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_mask
        FROM o GROUP BY pair_id
    """,
    "op6_host_rules": host_rules.oracle_sql(),
    "op8_licence_sentences": licences.oracle_sql(),
    "op12_prefix_trie": prefix_trie.oracle_sql(),
    "op13_vector_codes": vector_codes.oracle_sql(),
}
