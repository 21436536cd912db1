"""The queries of this subpackage: opN_<name> over whole tables with production parameters, the pipeline, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import bpe, decontaminate, gif, language, lines, merkle, pipeline, quality, shards, simhash, substrings, tries, urls, wavelet
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op3_line_dedup_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_line_dedup with a bound that grows with the line."""
    return lines.line_report(table(spark, sf_dir, "documents"), wide=True)


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(table(spark, sf_dir, "documents"))


def op5_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.id_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_report(table(spark, sf_dir, "documents"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_report(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie_report(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        "pipeline": pipeline.run,
        "op1_simhash": op1_simhash,
        "op2_kd_tree": op2_kd_tree,
        "op3_line_dedup": op3_line_dedup,
        "op3_line_dedup_wide": op3_line_dedup_wide,
        "op4_recompression": op4_recompression,
        "op5_wavelet_ids": op5_wavelet_ids,
        "op6_gif": op6_gif,
        "op7_rule_ensemble": op7_rule_ensemble,
        "op8_language_mixture": op8_language_mixture,
        "op9_decontaminate": op9_decontaminate,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_url_filters": op11_url_filters,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
    return {name: _shipped(query) for name, query in own.items()}


def oracle_sql() -> dict[str, str]:
    found = {"op3_line_dedup": lines.SQL, "op4_recompression": substrings.SQL, "op9_decontaminate": OP9_SQL, "op11_url_filters": urls.SQL, "op12_prefix_trie": tries.SQL, "op13_merkle_manifest": merkle.SQL}
    return found | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})


_OP9_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP9_SQL = f"""
WITH items AS (SELECT item_id, {_OP9_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM wins),
docs AS (SELECT doc_id, {_OP9_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m),
occ AS (SELECT doc_id, i, s.m, item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM starts) s JOIN wins USING (m, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
