"""A corpus pipeline of five stages, each over all that the one before it kept.

1. language: documents without a language (no text, no letter, or no language that holds three tenths of the words) go.
2. lines: lines that stand earlier, equal or within one edit, go; documents stay.
3. near_duplicates: of each group of linked fingerprints the document of the smallest doc_id stays.
4. benchmark: documents that benchmark items contaminate go; the others stay as they are.
5. tokens: byte-level BPE encoding of the texts, and their decoding.

Null, empty and wordless texts go in the first stage. Columns of documents may be null and may have any name: stages work
under names of their own, starting with two underscores, and all but the last return the columns they got. Rows with
a null doc_id are judged like any other: their lines are neither compared nor removed, and they come after all keys when
a group keeps one. Of rows that repeat doc_id and text one stays; different texts under one doc_id are judged apart. Texts
of any length are whole. Without benchmark items nothing is contaminated; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, lines, simhash
from .common import materialise, table

#: Share of its words that a document's main language has at least. Clean documents may mix three languages, so half of
#: the words would be too much to ask. Words that no language explains better than chance count as nobody's.
LEAST_SHARE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.where(~language.held_out()))
    names = ("__language", "__share", "__languages")
    judged = language.predict(docs, model, of_all=True, names=names)
    return judged.where((F.col("__language") != "und") & (F.col("__share") >= LEAST_SHARE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(docs, counts=("__n_lines", "__n_removed"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each_group(docs, null_keys=True)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_keys_gone(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: Hashes of shingles, mixtures of languages and byte-level BPE are beyond SQL: tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
