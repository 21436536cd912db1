"""A stream's result beside the batch query after every prefix, and its state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import timeline
from cartulary.streaming.reconcile import STORE, consistency_stream

SCHEMA = "document_id string, kind string, date_iso string, ts timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, STORE)
    yield spark
    spark.conf.set(key, was)


def test_after_every_prefix_as_the_batch_query(rocks, tmp_path):
    r, start, seen, got = random.Random(2), datetime.datetime(2024, 1, 1), [], {}
    batches = []
    for i in range(5):
        rows = [(f"d{r.randrange(6)}", r.choice(["seed", "event"]), r.choice(["2024-01-01", "2024-01-02", None]), start + datetime.timedelta(hours=i, minutes=r.randrange(60))) for _ in range(25)]
        batches.append(rows)
    batches.append([("late", "seed", "2024-01-01", start + datetime.timedelta(days=30)), ("late", "event", "2024-01-01", start + datetime.timedelta(days=30))])
    batches.append([("later", "seed", "2024-01-01", start + datetime.timedelta(days=31))])
    folder = tmp_path / "in"
    folder.mkdir()
    stream = rocks.readStream.schema(SCHEMA).parquet(str(folder))
    out = consistency_stream(stream.where("kind = 'seed'"), stream.where("kind = 'event'"), "document_id", "date_iso", delay="1 hour", quiet_seconds=86400)

    def keep(df, _):
        for x in df.collect():
            got[x["document_id"]] = tuple(x)[1:]

    query = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).start()
    try:
        sizes = []
        for i, rows in enumerate(batches):
            rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
            query.processAllAvailable()
            seen += rows
            df = rocks.createDataFrame(seen, SCHEMA).withColumn("date_iso", F.coalesce("date_iso", F.lit("")))
            want = {x["document_id"]: (x["n_a"], x["n_b"], x["consistent"]) for x in timeline.consistency(df.where("kind = 'seed'"), df.where("kind = 'event'"), "document_id", "date_iso").collect()}
            assert {k: v[:3] for k, v in got.items()} == want
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress["stateOperators"] else 0)
        assert {k for k, v in got.items() if v[3]} == {f"d{i}" for i in range(6)}  # the quiet ones were closed
        assert sizes[-1] < max(sizes)
    finally:
        query.stop()
