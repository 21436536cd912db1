"""The data source of document records: runs of bytes, whole jobs only, skipped files, streams."""

import datetime
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.sources.connector import Place, Reader, lines_of, register

SCHEMA = "document_id long, title string, tags array<string>, facts map<string,double>, own struct<day:date,at:timestamp,raw:binary>, price decimal(10,2)"


@pytest.fixture(scope="module")
def source(spark):
    register(spark)
    return spark


def records(spark, low, high):
    rows = [(i, None if i % 5 == 0 else f"título {i}\nx", ["a", None], {"k": i / 4}, (datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5), bytearray(b"\x00\xff")), None if i % 3 else 1) for i in range(low, high)]
    return spark.createDataFrame(rows, SCHEMA.replace("decimal(10,2)", "int")).withColumn("price", F.col("price").cast("decimal(10,2)"))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_records_come_back(source, tmp_path):
    at = str(tmp_path / "r")
    written = records(source, 0, 200).repartition(3)
    written.write.format("records").mode("append").save(at)
    read = source.read.format("records").schema(SCHEMA).option("bytes", 700)
    same(written, read.load(at))
    assert read.load(at).rdd.getNumPartitions() > 20
    written.limit(0).write.format("records").mode("append").save(at)
    records(source, 200, 210).write.format("records").mode("append").save(at)
    same(records(source, 0, 210), read.load(at))
    records(source, 5, 9).write.format("records").mode("overwrite").save(at)
    same(records(source, 5, 9), read.load(at))


def test_filters_on_the_key_skip_files(source, tmp_path):
    at = str(tmp_path / "r")
    for low in (0, 100, 200):
        records(source, low, low + 100).coalesce(1).write.format("records").mode("append").save(at)
    df = source.read.format("records").schema(SCHEMA).load(at)
    for test, files in (("document_id = 150", 1), ("document_id >= 100", 2), ("document_id < 100", 1), ("document_id IN (1, 299)", 2), ("document_id > 1000", 1), ("title LIKE 'x%'", 3), ("document_id <=> 3", 3)):
        found = df.where(test)
        assert found.rdd.getNumPartitions() == files, test  # one empty run stands for none
        same(records(source, 0, 300).where(test), found)


def test_a_job_that_fails_leaves_nothing(source, tmp_path):
    at = str(tmp_path / "r")
    records(source, 0, 10).write.format("records").mode("append").save(at)
    bad = records(source, 10, 50).repartition(4).withColumn("title", F.when(F.col("document_id") == 33, F.raise_error(F.lit("broken"))).otherwise("fine"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("records").mode("append").save(at)
    same(records(source, 0, 10), source.read.format("records").schema(SCHEMA).load(at))
    assert len(Place(at).entries()) == 1 and len(list((tmp_path / "r").glob("*/part-*"))) == len(Place(at).entries()[0][1]["files"])


def test_lines_that_are_no_records(source, tmp_path):
    place = Place(str(tmp_path / "r"))
    place.write("a.jsonl", b'{"document_id": "7", "title": {"a": 1}, "tags": 3}\nno json\n\n[1]\n{"document_id": 8')
    size = len(place.read("a.jsonl"))
    place.write("_commits/000000000000.json", json.dumps({"job": "x", "overwrite": False, "files": [{"file": "a.jsonl", "rows": 4, "size": size, "least": None, "most": None}]}).encode())
    got = source.read.format("records").schema("document_id long, title string, tags array<string>").load(str(tmp_path / "r")).collect()
    assert sorted(map(tuple, got), key=str) == [(7, '{"a": 1}', None), (None, None, None), (None, None, None), (None, None, None)]
    assert Reader.may_hold({"least": None, "most": None}, object()) is False


@settings(max_examples=200, deadline=None)
@given(lines=st.lists(st.binary(max_size=6).map(lambda b: b.replace(b"\n", b"")), max_size=8), end=st.booleans(), run=st.integers(1, 9), step=st.integers(1, 5))
def test_each_line_is_in_one_run(lines, end, run, step):
    data = b"\n".join(lines) + (b"\n" if end else b"")
    got = [x for at in range(0, len(data), run) for x in lines_of(io.BytesIO(data), at, min(at + run, len(data)), step)]
    assert got == [x for x in lines if x.strip()]


def test_streams_of_records(source, tmp_path):
    at, to = str(tmp_path / "in"), str(tmp_path / "out")
    records(source, 0, 10).write.format("records").mode("append").save(at)

    def run():
        stream = source.readStream.format("records").schema(SCHEMA).load(at)
        query = stream.writeStream.format("records").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(to)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    records(source, 10, 15).write.format("records").mode("append").save(at)
    run()
    run()
    same(records(source, 0, 15), source.read.format("records").schema(SCHEMA).load(to))
    assert len(Place(to).entries()) == 2
    made = Place(to)
    made.commit([], False, made.entries()[-1][1]["job"])  # a batch that is tried again
    assert len(made.entries()) == 2
