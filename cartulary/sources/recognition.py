"""What engines outside of Spark add to files: spans of a page's layout, recognised text, transcripts and safety scores.

An engine is a Python function that users give. Without one a page or file gives a row that says so, and nothing fails. Layout
is read by the library itself."""

from __future__ import annotations

import os
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_quality
from ..operators import segment
from ..session import kept
from . import pdf
from .files import contents, each_file


@dataclass(frozen=True)
class Options:
    """How pages are recognised; ``max_pages`` None: all of them, ``seconds`` None: however long it takes."""

    enabled: bool = True
    min_text_len: int = 20
    max_pages: int | None = 3
    dpi: int = 200
    seconds: float | None = 24.0

    @staticmethod
    def from_environment(prefix: str = "OCR_", source: dict[str, str] | None = None) -> Options:
        """Settings named after the fields, in capitals; what isn't set or is no number keeps its default."""
        source = dict(os.environ) if source is None else source
        said = {k: source.get(f"{prefix}{k.upper()}") for k in ("enabled", "min_text_len", "max_pages", "dpi", "seconds")}
        numbers = {k: int(v) for k, v in said.items() if k != "enabled" and v is not None and v.strip().isdigit()}
        return Options(enabled=str(said["enabled"] or "true").lower() not in ("0", "false", "no", "off"), **numbers)


SPANS = "page int, span_ord int, text string, bbox array<double>"
WORDS = "page int, span_ord int, text string, bbox array<double>, confidence double"
TRANSCRIPT = "segment int, start_s double, end_s double, text string"
#: Least confidence of a recognised word, and least score of a picture that isn't safe.
LEAST_WORD_CONFIDENCE, UNSAFE = 20.0, 0.7


def well_formed(spans: list[tuple]) -> list[tuple]:
    """Spans with text and a box of four numbers, numbered by page."""
    out, count = [], {}
    for page, _, text, box, *more in spans:
        if text and text.strip() and isinstance(box, (list, tuple)) and len(box) == 4:
            count[page] = count.get(page, -1) + 1
            out.append((page, count[page], text.strip(), [float(x) for x in box], *more))
    return out


def layout_spans(spark: SparkSession, path: str, layout: Callable[[bytes], list] | None = None) -> DataFrame:
    """(path, page, span_ord, text, bbox) of PDF files below path, of all their pages: by the library's own reader, or by
    layout(content), which gives (page, 0, text, box) of each span."""
    files = contents(spark, path, ("pdf",))
    if layout is None:
        return pdf.spans(pdf.pages(files)).where("text IS NOT NULL").select("path", "page", "span_ord", F.trim("text").alias("text"), "bbox")
    return each_file(files, lambda _, data: well_formed(layout(data)), SPANS)


@contextmanager
def at_most(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in what takes longer. Python's workers run a task in their main thread, where alarms are heard."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_) -> None:
        raise TimeoutError(f"no answer within {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def recognised(spark: SparkSession, path: str, engine: Callable[[bytes], list] | None, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(words, pages): words (path, page, span_ord, text, bbox, confidence) that an engine is sure enough of, and pages (path,
    status, warning): success, degraded where the engine failed or took too long, skipped where there is none or it is off. Pages beyond
    ``max_pages`` are left out, and the warning names how many.

    engine: bytes of a picture or page to (page, 0, text, box, confidence) of each word. It is called once a file: what it
    says is written to the shared folder, and both tables are read from there."""
    on = options.enabled and engine is not None

    def call(_: str, data: bytes) -> list[tuple]:
        if not on:
            return [("skipped", "ocr_disabled" if not options.enabled else "no_engine", None, None, None, None, None)]
        try:
            with at_most(options.seconds):
                found = [w for w in well_formed(engine(data)) if w[4] >= LEAST_WORD_CONFIDENCE]
        except Exception as e:  # whatever an engine raises, the page is degraded
            return [("degraded", f"{type(e).__name__}: {e}"[:200], None, None, None, None, None)]
        words = [w for w in found if options.max_pages is None or w[0] <= options.max_pages]
        left = len({w[0] for w in found} - {w[0] for w in words})
        said = ["little recognised text"] * (sum(len(w[2]) for w in words) < options.min_text_len) + [f"{left} pages beyond the first {options.max_pages} left out"] * (left > 0)
        return [("success", "; ".join(said) or None, None, None, None, None, None), *[(None, None, *w) for w in words]]

    rows = kept(each_file(contents(spark, path), call, f"status string, warning string, {WORDS}"), "recognised")
    return rows.where("status IS NULL").select("path", "page", "span_ord", "text", "bbox", "confidence"), rows.where("status IS NOT NULL").select("path", "status", "warning")


def best_readings(texts: DataFrame, words: DataFrame, status: DataFrame) -> DataFrame:
    """(path, page, text, source, warning): of read_texts() and recognised(), the better reading of each page. A good native text stays as it is."""
    on = ["path", "page"]
    seen = segment.spans_text(words, on).select(*on, clean_text(F.col("text")).alias("ocr_text"))
    strategy = segment.page_strategy(text_quality("text"), F.length(F.trim(F.coalesce("text", F.lit("")))), F.col("n_images"))
    rows = texts.withColumn("strategy", F.when(F.col("source").isin("text", "docx", "xlsx"), "native_text").otherwise(strategy))
    good = rows.where("strategy = 'native_text'").select(*on, "text", "source", "warning")
    poor = rows.where("strategy <> 'native_text'").select(*on, F.col("text").alias("native_text"), F.col("warning").alias("native_warning"))
    merged = segment.merge_readings(poor, seen.join(good.select(*on), on, "left_anti"), on, text_quality)
    how = status.select("path", "status", F.col("warning").alias("engine_warning"))
    state = reading_status(F.col("status"), F.col("ocr_text"))["status"]
    said = F.nullif(F.concat_ws("; ", F.when(F.col("source") == "none", "native_warning"), F.when(state != "success", F.concat(F.lit("recognition "), state)), "engine_warning"), F.lit(""))
    return good.unionByName(merged.join(how, "path", "left").select(*on, F.nullif("text", F.lit("")).alias("text"), "source", F.when(F.col("source") == "native", F.col("native_warning")).otherwise(said).alias("warning")))


def best_spans(spans: DataFrame, words: DataFrame) -> DataFrame:
    """(path, page, span_ord, text, bbox): a page's native spans, or the recognised words of a page that has none."""
    found = words.join(spans.select("path", "page").distinct(), ["path", "page"], "left_anti")
    return spans.unionByName(found.select("path", "page", "span_ord", "text", "bbox"))


def transcripts(spark: SparkSession, path: str, engine: Callable[[bytes], list[tuple[float, float, str]]]) -> DataFrame:
    """(path, segment, start_s, end_s, text) of sounds and films, by an engine of the user's."""
    return each_file(contents(spark, path), lambda _, data: [(i, float(a), float(b), t.strip()) for i, (a, b, t) in enumerate(engine(data))], TRANSCRIPT)


def safety(scores: DataFrame, score: str = "score", threshold: float = UNSAFE) -> DataFrame:
    """scores with ``unsafe``: at or above the threshold; a missing score (no model) is safe and says so."""
    return scores.withColumn("unsafe", F.coalesce(F.col(score) >= threshold, F.lit(False))).withColumn("safety_status", F.when(F.col(score).isNull(), "no_model").otherwise("scored"))


# --- decisions on pages ----------------------------------------------------------------------------------------------


def orientation_score(text: Column, width: Column, height: Column, hints: list[str]) -> Column:
    """How much a reading of a page looks upright: words and numbers count for it, odd signs against it, known words and a
    portrait shape for it."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), 0))
    known = sum((F.contains(F.lower(t), F.lit(h)).cast("int") for h in hints), F.lit(0))
    return 2.0 * count(r"\p{L}{3,}") + 0.7 * count(r"\d{2,}") - 0.5 * count(r"[^\p{L}\d\s.,;:!?()/%'\"-]") + 4.0 * known + F.when(height >= width, 1.5).otherwise(0.0)


def best_orientation(readings: DataFrame, keys: list[str], hints: list[str]) -> DataFrame:
    """readings(keys, angle, text, width, height) -> (keys, angle): only landscape pages are turned, by the best reading of 0, 90
    and 270 degrees; the smaller angle wins ties."""
    from ..operators.ranking import best

    landscape = F.col("width") > 1.15 * F.col("height")
    rows = readings.where((F.col("angle") == 0) | (landscape & F.col("angle").isin(90, 270)))
    rows = rows.withColumn("score", orientation_score(F.col("text"), F.col("width"), F.col("height"), hints))
    return best(rows, keys, [F.col("score").desc(), F.col("angle")]).select(*keys, "angle", "score")


def clean_text(text: Column) -> Column:
    """Recognised text without control characters, runs of spaces and more than one blank line."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B-\x1F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def pages_to_recognise(pages: DataFrame, strategies: DataFrame, keys: list[str], default: str = "ocr_heavy") -> tuple[DataFrame, DataFrame]:
    """(wanted, skipped): pages whose strategy is a light or heavy recognition, that being the default; and the others as rows
    that say why."""
    rows = pages.join(strategies.select(*keys, "strategy"), keys, "left").withColumn("strategy", F.coalesce("strategy", F.lit(default)))
    wanted = F.col("strategy").isin("ocr_light", "ocr_heavy")
    skipped = rows.where(~wanted).select(*keys, F.lit("skipped").alias("status"), F.concat(F.lit("strategy_"), "strategy").alias("warning"))
    return rows.where(wanted), skipped


def reading_status(status: Column, text: Column) -> Column:
    """struct(status, degraded_mode) of a page's reading."""
    done = F.when(status.isNull() | (status == "skipped"), "skipped").when((status == "degraded") | (F.trim(F.coalesce(text, F.lit(""))) == ""), "degraded").otherwise("success")
    return F.struct(done.alias("status"), F.when(done == "degraded", "page_without_text").alias("degraded_mode"))


def literal_confidence(strategy: Column, engine_ok: Column) -> Column:
    """How sure the literal text of a document is, by where it comes from."""
    return F.when(strategy == "native", 0.95).when(strategy == "hybrid", 0.93).when(engine_ok, 0.92).otherwise(0.90)
