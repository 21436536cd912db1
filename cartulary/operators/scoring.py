"""Benchmark scoring: tables of checks to axes, roll-ups and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("entidades", "eventos", "evidencia", "confiabilidade", "utilidade_juridica")


def axis_scores(checks: DataFrame, case: str = "case_id") -> DataFrame:
    """checks(case, axis, ok) -> percentage of true checks for each case and axis. An axis without checks scores 0."""
    return checks.groupBy(case, "axis").agg((100.0 * F.avg(F.col("ok").cast("int"))).alias("score"))


def case_scores(checks: DataFrame, axes=AXES, case: str = "case_id") -> DataFrame:
    """One row a case: the score of each axis, their mean, and the number of failed checks."""
    own = [F.coalesce(F.avg(F.when(F.col("axis") == a, 100.0 * F.col("ok").cast("int"))), F.lit(0.0)).alias(a) for a in axes]
    scored = checks.groupBy(case).agg(*own, F.count_if(~F.col("ok")).alias("regressions"))
    mean = sum((F.col(a) for a in axes), F.lit(0.0)) / len(axes)
    return scored.select(case, *[F.round(a, 2).alias(a) for a in axes], F.round(mean, 2).alias("score"), "regressions")


def roll_up(cases: DataFrame, axes=AXES) -> DataFrame:
    """Mean of each axis over the cases, and the mean of those means."""
    means = cases.agg(*[F.round(F.avg(a), 2).alias(a) for a in axes], F.count("*").alias("cases"), F.sum("regressions").alias("regressions"))
    return means.withColumn("overall", F.round(sum((F.col(a) for a in axes), F.lit(0.0)) / len(axes), 2))


def bounded(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def gate(cases: DataFrame, clean: DataFrame, sentinels: DataFrame, least: float = 90.0, case: str = "case_id") -> DataFrame:
    """Every clean case is there, scores enough and has no regression; every sentinel still regresses."""
    good = clean.join(cases, case, "left").select(case, F.lit("clean").alias("role"), F.coalesce((F.col("score") >= least) & (F.col("regressions") == 0), F.lit(False)).alias("ok"))
    still = sentinels.join(cases, case, "left").select(case, F.lit("sentinel").alias("role"), F.coalesce(F.col("regressions") > 0, F.lit(False)).alias("ok"))
    return good.unionByName(still)
