"""Table functions for SQL: spans of PDF files, lines of pages, and words that an engine recognises.

    register(spark)
    SELECT f.path, s.* FROM files f, LATERAL pdf_spans(f.content) s
    SELECT * FROM page_lines(TABLE(spans))      -- spans(path, page, span_ord, text, bbox, size), dealt by page and sorted by itself

A function is called once for each file or page and hands on rows as it finds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..session import ship
from . import pdf
from .recognition import LEAST_WORD_CONFIDENCE, Options, at_most, well_formed



def _struct(**kinds: T.DataType) -> T.StructType:
    """analyze() runs without a session, so schemas are put together and not parsed."""
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_PLACE = {"page": T.IntegerType(), "span_ord": T.IntegerType(), "text": T.StringType(), "bbox": T.ArrayType(T.DoubleType())}
SPAN_ROW = _struct(**_PLACE, size=T.DoubleType(), warning=T.StringType())
LINE_ROW = _struct(path=T.StringType(), page=T.IntegerType(), line=T.IntegerType(), text=T.StringType(), bbox=T.ArrayType(T.DoubleType()))
WORD_ROW = _struct(status=T.StringType(), warning=T.StringType(), **_PLACE, confidence=T.DoubleType())


def _binary(argument: AnalyzeArgument, of: str) -> None:
    if not isinstance(argument.dataType, T.BinaryType) or argument.isTable:
        raise ValueError(f"{of} takes the content of a file")


class PdfSpans:
    """(page, span_ord, text, bbox, size, warning) of a PDF file's content; a file or page that can't be read is one row with a warning."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        _binary(content, "pdf_spans")
        return AnalyzeResult(SPAN_ROW)

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            for page, *_, commands, fonts, warning in pdf.read_pages(bytes(content or b"")):
                if warning is not None:
                    yield page, None, None, None, None, warning
                    continue
                for i, (text, box, size) in enumerate(pdf.draw_page(commands, fonts)):
                    yield page, i, text, box, size, None
        except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, zlib.error) as e:
            yield 0, None, None, None, None, f"{type(e).__name__}: {e}"[:200]


class PageLines:
    """(path, page, line, text, bbox) of a table of spans: the same lines as pdf.lines(). It asks for its rows by page and in order."""

    @staticmethod
    def analyze(spans: AnalyzeArgument) -> AnalyzeResult:
        missing = {"path", "page", "span_ord", "text", "bbox", "size"} - set(spans.dataType.fieldNames() if spans.isTable else ())
        if missing:
            raise ValueError(f"page_lines takes a table with the columns {', '.join(sorted(missing))}")
        return AnalyzeResult(LINE_ROW, partitionBy=[PartitioningColumn("path"), PartitioningColumn("page")], orderBy=[OrderingColumn("span_ord")])

    def __init__(self) -> None:
        self.key, self.number, self.before, self.text, self.box = None, 0, None, "", []

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["text"] is None:
            return
        box, size = list(row["bbox"]), row["size"]
        new = self.before is None or abs(box[3] - self.before[3]) > pdf.STEP * max(size, 1.0) or box[0] < self.before[0] - size
        if new:
            yield from self.terminate()
            self.key, self.number, self.text, self.box = (row["path"], row["page"]), self.number + 1, row["text"], box
        else:
            self.text += (" " if box[0] - self.before[2] > pdf.SPACE * size else "") + row["text"]
            self.box = [min(self.box[0], box[0]), min(self.box[1], box[1]), max(self.box[2], box[2]), max(self.box[3], box[3])]
        self.before = box

    def terminate(self) -> Iterator[tuple]:
        if self.key is not None:
            yield *self.key, self.number, self.text.rstrip(" "), self.box
            self.key = None


def recogniser(engine: Callable[[bytes], list], options: Options = Options()) -> type:
    """The class of a table function: (status, warning, page, span_ord, text, bbox, confidence) of a content, first a row on the whole, then its words."""

    class Recognise:
        @staticmethod
        def analyze(content: AnalyzeArgument) -> AnalyzeResult:
            _binary(content, "recognise")
            return AnalyzeResult(WORD_ROW)

        def eval(self, content: bytes) -> Iterator[tuple]:
            nothing = (None,) * 5
            if not options.enabled:
                yield "skipped", "ocr_disabled", *nothing
                return
            try:
                with at_most(options.seconds):
                    found = [w for w in well_formed(engine(bytes(content or b""))) if w[4] >= LEAST_WORD_CONFIDENCE]
            except Exception as e:  # whatever an engine raises, the page is degraded
                yield "degraded", f"{type(e).__name__}: {e}"[:200], *nothing
                return
            words = [w for w in found if options.max_pages is None or w[0] <= options.max_pages]
            left = len({w[0] for w in found} - {w[0] for w in words})
            yield "success", f"{left} pages beyond the first {options.max_pages} left out" if left else None, *nothing
            for w in words:
                yield None, None, *w

    return Recognise


def register(spark: SparkSession, engine: Callable[[bytes], list] | None = None, options: Options = Options()) -> None:
    """Makes pdf_spans and page_lines known to a session, and recognise if there is an engine."""
    ship(spark)
    functions = {"pdf_spans": PdfSpans, "page_lines": PageLines} | ({"recognise": recogniser(engine, options)} if engine else {})
    for name, made in functions.items():
        spark.udtf.register(name, udtf(made))
