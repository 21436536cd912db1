"""Table functions in SQL beside the tables that say the same."""

import pytest
from pyspark.sql import functions as F

from cartulary.sources import pdf, table_functions

from .test_pdf import simple


@pytest.fixture(scope="module")
def files(spark):
    def engine(data):
        if data == b"bad":
            raise RuntimeError("no picture")
        return [(1, 0, "word", (0, 0, 1, 1), 90.0), (1, 0, "unsure", (0, 0, 1, 1), 3.0), (9, 0, "far", (0, 0, 1, 1), 90.0)]

    table_functions.register(spark, engine)
    rows = [("hand", bytearray(simple())), ("made", bytearray(pdf.write_pdf([["one two", "", "three"], [], ["four"]]))), ("bad", bytearray(b"bad")), ("none", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    df.createOrReplaceTempView("udtf_files")
    return df


def test_spans_and_lines_as_tables(spark, files):
    said = spark.sql("SELECT f.path, s.* FROM udtf_files f, LATERAL pdf_spans(f.content) s")
    want = pdf.spans(pdf.pages(files))
    names = ["path", "page", "span_ord", "text", "bbox", "size"]
    as_rows = lambda df, cols: sorted(map(str, df.where("text IS NOT NULL").select(*cols).collect()))
    assert as_rows(said, names) == as_rows(want, names) and said.where("warning IS NOT NULL").count() == 2
    said.createOrReplaceTempView("udtf_spans")
    cols = ["path", "page", "line", "text", "bbox"]
    assert as_rows(spark.sql("SELECT * FROM page_lines(TABLE(udtf_spans))"), cols) == as_rows(pdf.lines(want).withColumn("line", F.col("line").cast("int")), cols)


def test_recognition_in_one_pass(spark, files):
    got = spark.sql("SELECT f.path, r.* FROM udtf_files f, LATERAL recognise(f.content) r").collect()
    assert {(r["path"], r["status"]) for r in got if r["status"]} == {("hand", "success"), ("made", "success"), ("bad", "degraded"), ("none", "success")}
    assert {r["text"] for r in got if r["status"] is None} == {"word"} and next(r for r in got if r["path"] == "hand" and r["status"])["warning"].startswith("1 pages beyond")


@pytest.mark.parametrize("wrong", ["SELECT * FROM pdf_spans('text')", "SELECT * FROM page_lines(TABLE(udtf_files))"])
def test_wrong_arguments_are_told(spark, files, wrong):
    with pytest.raises(Exception, match="takes"):
        spark.sql(wrong).collect()
