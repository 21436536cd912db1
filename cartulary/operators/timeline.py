"""Timelines: seeds, events, reconciliation of two sources, consistency, summaries, merging of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(events: DataFrame, seeds: DataFrame, scope: list[str], singletons: list[str]) -> DataFrame:
    """events and seeds (scope, event_type, date, evidence, place) -> events, repaired and completed by seeds.

    A seed with the date of an event of its type and scope is that event. Another seed of a singleton type repairs
    the last event of its type (the last such seed in order wins). All other seeds are appended."""
    key = [*scope, "event_type"]
    new = seeds.join(events.select(*key, "date").distinct(), [*key, "date"], "left_anti")
    single = F.col("event_type").isin(singletons)
    have = events.where(single).groupBy(*key).agg(F.max("place").alias("__last"))
    patch = new.where(single).groupBy(*key).agg(F.max_by(F.struct("date", "evidence"), F.struct("date", "place")).alias("__patch"))
    fixed = events.join(have, key, "left").join(patch, key, "left")
    hit = F.col("__patch").isNotNull() & (F.col("place") == F.col("__last"))
    fixed = fixed.select(*key, F.when(hit, F.col("__patch.date")).otherwise(F.col("date")).alias("date"), F.when(hit, F.col("__patch.evidence")).otherwise(F.col("evidence")).alias("evidence"), F.when(hit, "patched").otherwise("event").alias("origin"))
    added = new.join(have, key, "left_anti").select(*key, "date", "evidence", F.lit("seed").alias("origin"))
    return fixed.unionByName(added)


def consistency(a: DataFrame, b: DataFrame, by: str, value: str) -> DataFrame:
    """Whether two sources hold the same values for each group: sizes and sorted lists."""
    lists = lambda df, n: df.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias(n))
    both = lists(a, "__a").join(lists(b, "__b"), by, "full")
    empty = F.array().cast(dict(both.dtypes)["__a"])
    x, y = F.coalesce("__a", empty), F.coalesce("__b", empty)
    return both.select(by, F.size(x).cast("long").alias("n_a"), F.size(y).cast("long").alias("n_b"), (x == y).alias("consistent"))


def summary(events: DataFrame, by: str) -> DataFrame:
    """Counts for each document: anchored (page and box), to review, by level of assertion."""
    level = lambda x: F.count_if(F.col("assertion_level") == x).alias(x)
    return events.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("page").isNotNull() & F.col("has_bbox")).alias("anchored"), F.count_if(F.col("review_state") != "auto_confirmed").alias("needs_review"), level("observed"), level("inferred"), level("unknown"))


def merge(documents: list[DataFrame], key: str, date: str) -> DataFrame:
    """Events of several documents with ``merged_pos`` from 1: each id once, from the first document that has it, by
    date; undated events come last."""
    tagged = None
    for i, d in enumerate(documents):
        d = d.withColumn("doc_ord", F.lit(i))
        tagged = d if tagged is None else tagged.unionByName(d)
    once = tagged.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy("doc_ord"))).where("__rn = 1").drop("__rn")
    return once


def in_order(df: DataFrame, scope: list[str], order: list[Column], name: str = "merged_pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
