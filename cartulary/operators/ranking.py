"""Choosing one of several rows: arguments of maxima with explicit ties, first and last of repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in the given order. Spark prunes ranks beyond k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return best(df, by, [F.col(c).asc() for c in order])


def last_value_first_place(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Of repeated keys the last value, at the first place."""
    return df.groupBy(*by).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def best_without(df: DataFrame, by: list[str], identity: str, taken: DataFrame, order: list[Column]) -> DataFrame:
    """The best row whose identity differs from the one that ``taken`` (by, identity) holds for the group: a second
    role never falls to who has the first."""
    other = df.join(taken.select(*by, F.col(identity).alias("__taken")), by, "left")
    return best(other.where(F.col("__taken").isNull() | (F.col("__taken") != F.col(identity))), by, order).drop("__taken")


def consolidate(df: DataFrame, by: list[str], code: str, score: Column, order: list[str]) -> DataFrame:
    """One row for each code of a group: that of the highest score, the earliest among equals."""
    return best(df.withColumn("score", score), [*by, code], [F.col("score").desc(), *[F.col(c).asc() for c in order]])


def first_present(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The first non-null value of each group."""
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(value, order).alias(value))


def first_source_wins(sources: list[DataFrame], by: str) -> DataFrame:
    """Rows of the first source that has any for the group; sources are given in order of precedence."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_ord", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    first = F.min("source_ord").over(Window.partitionBy(by))
    return tagged.withColumn("__first", first).where("source_ord = __first").drop("__first")


def best_match(left: DataFrame, right: DataFrame, on: list[str], left_key: list[str], score: Column, least: float, ties: list[str]) -> DataFrame:
    """For each left row the right row of the same group with the highest score, if it is high enough; first wins."""
    scored = left.join(right, on).withColumn("score", score).where(F.col("score") >= least)
    return best(scored, left_key, [F.col("score").desc(), *[F.col(t).asc() for t in ties]])
