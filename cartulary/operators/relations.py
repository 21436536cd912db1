"""Relation graphs between the units of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(df: DataFrame, scope: list[str], place: str) -> DataFrame:
    """a and b of the same scope, a before b: an equi join on the scope with the order as a residual condition."""
    a, b = df.alias("a"), df.alias("b")
    on = F.col(f"a.{place}") < F.col(f"b.{place}")
    for c in scope:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on)


def edges(pairs_df: DataFrame, keys: list[Column], kinds: list[tuple[str, Column, float]], unknown: tuple[Column, float] | None = None) -> DataFrame:
    """(keys, relation_type, confidence): an edge for each kind whose condition holds; unknown only where no kind does
    and its own condition holds."""
    made = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("relation_type"), F.lit(s).alias("confidence"))) for k, c, s in kinds]))
    if unknown is not None:
        condition, s = unknown
        other = F.array(F.struct(F.lit("unknown").alias("relation_type"), F.lit(s).alias("confidence")))
        made = F.when(F.size(made) > 0, made).when(condition, other)
    return pairs_df.select(*keys, F.explode(made).alias("e")).select("*", "e.*").drop("e")


def unit_relations(units: DataFrame) -> DataFrame:
    """units(document_id, unit_ord, unit_id, patient, provider, document_date, codes, has_gap) -> the six kinds of edges
    between the sub-documents of a document. Names are compared as relation names."""
    from ..functions.text import relation_name

    named = units.withColumn("p", F.nullif(relation_name("patient"), F.lit(""))).withColumn("d", F.nullif(relation_name("provider"), F.lit("")))
    both = pairs(named, ["document_id"], "unit_ord")
    same_patient, same_provider = F.col("a.p") == F.col("b.p"), F.col("a.d") == F.col("b.d")
    close = F.abs(F.datediff("a.document_date", "b.document_date")) <= 30
    shared = F.coalesce(F.arrays_overlap("a.codes", "b.codes"), F.lit(False))
    episode = same_patient & (F.coalesce(close, F.lit(False)) | shared)
    follows = (F.col("b.unit_ord") == F.col("a.unit_ord") + 1) & same_patient & same_provider
    kinds = [("same_patient", same_patient, 0.97), ("same_provider", same_provider, 0.95), ("same_episode", episode, 0.90), ("same_document_continuation", follows, 0.94), ("conflict", F.col("a.p") != F.col("b.p"), 0.98)]
    keys = [F.col("a.document_id"), F.col("a.unit_id").alias("source"), F.col("b.unit_id").alias("target")]
    return edges(both, keys, kinds, (F.col("a.has_gap") | F.col("b.has_gap"), 0.35))
