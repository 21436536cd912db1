"""Pages into runs and sub-documents; strategies of pages and documents; merging two readings of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_runs(df: DataFrame, by: str, order: list[str], kind: str, absorbing: str) -> DataFrame:
    """df with ``segment`` from 1: a row opens a new one when its kind is neither the absorbing kind nor that of the
    current segment. Rows of the absorbing kind join the segment before them."""
    w = Window.partitionBy(by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    current = F.coalesce(F.last(F.nullif(F.col(kind), F.lit(absorbing)), True).over(before), F.lit(absorbing))
    opens = (F.row_number().over(w) > 1) & (F.col(kind) != absorbing) & (F.col(kind) != current)
    to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("segment", F.sum("__opens").over(to_here) + 1).drop("__opens")


def subdoc_id(segment: Column) -> Column:
    return F.format_string("subdoc_%03d", segment)


def grouped_text(df: DataFrame, by: list[str], order: str, text: str, joint: str = "\n") -> DataFrame:
    """First place, number of rows and ordered text of each group; blank texts are left out of it."""
    parts = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(order, text))))
    return df.groupBy(*by).agg(F.min(order).alias("first_place"), F.count("*").alias("n_pages"), F.array_join(F.transform(parts, lambda p: p[text]), joint).alias("full_text"))


def page_strategy(quality: Column, n_chars: Column, n_images: Column) -> Column:
    """How to read a page: its native text, or recognition of its image, light or heavy."""
    return F.when((quality >= 2.5) & (n_chars >= 80), "native_text").when((n_chars == 0) & (n_images > 0), "image_only").when(quality >= 1.2, "ocr_light").otherwise("ocr_heavy")


def document_strategy(pages: DataFrame, by: str, n_chars: str, good: int = 40) -> DataFrame:
    """native where every page has text, ocr where none or hardly any has, hybrid between."""
    found = pages.groupBy(by).agg(F.count("*").alias("n_pages"), F.sum(n_chars).alias("total_chars"), F.count_if(F.col(n_chars) == 0).alias("empty_pages"), F.count_if(F.col(n_chars) >= good).alias("good_pages"))
    strategy = F.when((F.col("total_chars") < good) | (F.col("good_pages") == 0), "ocr").when(F.col("good_pages") == F.col("n_pages"), "native").otherwise("hybrid")
    return found.withColumn("strategy", strategy)


def merge_readings(native: DataFrame, ocr: DataFrame, on: list[str], quality, least: float = 2.5) -> DataFrame:
    """Full outer join of two readings of pages: the native text if it is good and not much shorter than the other,
    else the recognised one if it is any good, else whichever isn't empty."""
    n, o = F.coalesce("native_text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    both = native.join(ocr, on, "full").withColumn("__n", quality(n)).withColumn("__o", quality(o))
    take_native = (F.col("__n") >= least) & (F.length(n) >= F.greatest(F.lit(20.0), 0.6 * F.length(o)))
    source = F.when(take_native, "native").when(F.col("__o") > 0, "ocr").when(F.length(n) > 0, "native").otherwise("none")
    return both.withColumn("source", source).withColumn("text", F.when(source == "native", n).when(source == "ocr", o).otherwise("")).drop("__n", "__o")


def spans_text(spans: DataFrame, by: list[str], joint: str = " ") -> DataFrame:
    """(by, text, n_spans): the spans of each page from top to bottom and from left to right, blank ones left out; spans at one
    place keep their order. spans(by, span_ord, text, bbox as [x0, y0, x1, y1])."""
    row = F.struct(F.col("bbox")[1].alias("y0"), F.col("bbox")[0].alias("x0"), "span_ord", F.trim("text").alias("text"))
    parts = F.array_sort(F.collect_list(F.when(F.trim("text") != "", row)))
    return spans.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["text"]), joint).alias("text"), F.count("*").alias("n_spans"))


def box(values: Column) -> Column:
    """A box as four numbers; null for anything else."""
    numbers = F.transform(values, lambda v: v.cast("string").try_cast("double"))
    return F.when((F.size(numbers) == 4) & F.forall(numbers, lambda v: v.isNotNull()), numbers)
