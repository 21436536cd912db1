"""Sinks: upserts into Parquet tables, dated folders, event logs and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last()))).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame | None, new: DataFrame, key: str, path: str) -> DataFrame:
    """Writes old with its rows replaced by those of new, under a path that neither is read from, and reads it back."""
    kept = new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
    kept.write.mode("overwrite").parquet(path)
    return new.sparkSession.read.parquet(path)


def merge_columns(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An update of single columns: values of new where it has any, else those of old."""
    both = old.alias("o").join(new.alias("n"), key, "full")
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    pick = lambda c: F.coalesce(*[F.col(f"{a}.{c}") for a, d in (("n", new), ("o", old)) if c in d.columns]).alias(c)
    return both.select(key, *[pick(c) for c in names if c != key])


def write_dated(df: DataFrame, date: str, path: str) -> None:
    """One folder for each year and month; dates that are no dates go to year 0."""
    d = F.to_date(F.col(date))
    df.withColumn("year", F.coalesce(F.year(d), F.lit(0))).withColumn("month", F.coalesce(F.month(d), F.lit(0))).write.mode("append").partitionBy("year", "month").parquet(path)


def processing_events(df: DataFrame, key: str, stage: str, engine: str, details: dict) -> DataFrame:
    """A log row for each document of a stage; details that are null are left out of the JSON, page and warning have
    columns of their own."""
    rest = {k: v for k, v in details.items() if k not in ("page", "warning_code")}
    own = lambda k, kind: (details[k] if k in details else F.lit(None)).cast(kind).alias(k)
    packed = F.to_json(F.struct(*[v.alias(k) for k, v in rest.items()])) if rest else F.lit("{}")
    return df.select(key, F.lit(stage).alias("stage"), F.lit(engine).alias("engine"), own("page", "int"), own("warning_code", "string"), packed.alias("details"))


def markdown_report(cases: DataFrame, totals: DataFrame, axes: tuple[str, ...]) -> str:
    """The report of a benchmark: totals and a line a case. Both tables are small: a case is a hand-written file."""
    t = totals.first()
    lines = ["# Benchmark", "", f"Overall: {t['overall']:.2f} / 100 over {t['cases']} cases, {t['regressions']} regressions", "", "| Axis | Score |", "|---|---:|"]
    lines += [f"| {a} | {t[a]:.2f} |" for a in axes] + ["", f"| Case | Score | {' | '.join(axes)} | Regressions |", "|---" * (len(axes) + 3) + "|"]
    for r in cases.orderBy("case_id").collect():
        lines.append(f"| {r['case_id']} | {r['score']:.2f} | {' | '.join(f'{r[a]:.2f}' for a in axes)} | {r['regressions']} |")
    return "\n".join(lines) + "\n"


def artefact_path(ingested_at: str, key: str) -> Column:
    """`artefacts/YYYY/MM/<id>`, by the time of ingestion; without one it is year and month 0."""
    year, month = F.coalesce(F.date_format(ingested_at, "yyyy"), F.lit("0000")), F.coalesce(F.date_format(ingested_at, "MM"), F.lit("00"))
    return F.concat_ws("/", F.lit("artefacts"), year, month, F.col(key))


def write_artefacts(files: DataFrame, key: str, path: str, ingested_at: str = "ingested_at") -> DataFrame:
    """files(key, content, ingested_at) as a table of contents in folders of year and month; returns (key, logical_path, size_bytes).
    A content is found again by its folder and id. What a folder has already under an id isn't written again, so a job may be rerun."""
    at = F.col(ingested_at)
    rows = files.withColumn("year", F.coalesce(F.year(at), F.lit(0))).withColumn("month", F.coalesce(F.month(at), F.lit(0))).select(key, "content", "year", "month")
    try:
        there = files.sparkSession.read.parquet(path).select(key, "year", "month")
        rows = rows.join(there, [key, "year", "month"], "left_anti")
    except AnalysisException as e:  # the table isn't there yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").partitionBy("year", "month").parquet(path)
    return files.select(key, artefact_path(ingested_at, key).alias("logical_path"), F.length("content").alias("size_bytes"))


def read_artefact(spark: SparkSession, path: str, key: str, value: str, logical_path: str | None = None) -> DataFrame:
    """(key, content) of an id. With its logical path only the folder of that year and month is read."""
    rows = spark.read.parquet(path).where(F.col(key) == value)
    if logical_path is not None:
        _, year, month, _ = logical_path.split("/", 3)
        rows = rows.where((F.col("year") == int(year)) & (F.col("month") == int(month)))
    return rows.select(key, "content")


def without_artefact(spark: SparkSession, path: str, key: str, value: str, to: str) -> None:
    """Writes the contents without one of them under another path."""
    spark.read.parquet(path).where(F.col(key) != value).write.partitionBy("year", "month").parquet(to)


def write_indexed(df: DataFrame, path: str, unique: list[str], order: list[str], partitions: int | None = None) -> None:
    """A table whose lookups by a unique column read few row groups (bloom filters) and whose scans by the order columns
    skip most of them (rows are dealt by range and sorted). What a document store would index."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    writer = ranged.sortWithinPartitions(*order).write.mode("overwrite")
    for c in unique:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def upsert_buckets(new: DataFrame, key: str, path: str, buckets: int = 64) -> DataFrame:
    """Replaces rows by key in a table that is dealt into buckets by a hash of the key: only buckets that new rows fall into
    are read and written again. The first call makes the table."""
    from ..session import kept

    spark = new.sparkSession
    rows = kept(new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "new-rows")
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]
    try:
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    except Exception as e:  # the table isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = rows.limit(0)
    merged = kept(old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).drop("bucket")
