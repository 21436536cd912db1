"""Texts beside items that every task has: against DuckDB, in one block of items and in many."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartulary.functions.text import ACCENTED, accent_fold, unaccented
from cartulary.operators import meeting
from cartulary.plans import catalogue

WORDS = "the and a of quick brown foxes jump over lazy dogs ação Straße dr silva x1 11 22 日本 É".split() + [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, at = random.Random(7), tmp_path_factory.mktemp("meeting")
    said = lambda n: r.choice([" ", " ", ", ", "  "]).join(r.choice(WORDS) for _ in range(n))
    items = [(i, said(r.randint(1, 25))) for i in range(60)] + [(60, None), (61, ""), (62, "absent"), (3, "another three of that id"), (None, "the and a")]
    cut = lambda t: t[r.randint(0, 3) : len(t) - r.randint(0, 3)]
    near = lambda t: " ".join(r.choice(WORDS) if r.random() < 0.15 else w for w in t.split(" "))
    line = lambda: r.choice([lambda: said(r.randint(0, 12)), lambda: cut(r.choice(items)[1] or ""), lambda: near(r.choice(items)[1] or ""), lambda: said(3) + " " + (r.choice(items)[1] or "") + "s it", lambda: ""])()
    docs = [(i, "\n".join(line() for _ in range(r.randint(1, 6)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "\n\n"), (5, docs[6][1]), (5, "the quick foxes"), docs[9], *((400 + i, docs[i][1]) for i in range(20))]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{at}/{name}.parquet")
    return str(at)


def oracle(tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in con.sql(catalogue.ORACLES[name]).fetchall()], key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark, tables, fold):
    side = lambda name, key, to: spark.read.parquet(f"{tables}/{name}.parquet").select(F.col(key).alias(to), fold("text").alias("text"))
    return side("documents", "doc_id", "key"), side("benchmark", "item_id", "item")


def test_best_lines_agree_with_sql_and_meet_without_a_join(spark, tables):
    got = catalogue.QUERIES["span_best_line_of_all"](spark, tables)
    assert "Join" not in plan(got)
    rows = got.select("item_id", "doc_id", "line_no", "score").collect()
    assert sorted([tuple(r) for r in rows], key=repr) == oracle(tables, "span_best_line_of_all") and len(rows) > 40


@pytest.mark.parametrize("sizes", [{"items_a_block": 7}, {"chars_a_block": 300}])
def test_best_lines_of_many_blocks(spark, tables, sizes):
    texts, items = sides(spark, tables, F.lower)
    whole, cut = (sorted(map(tuple, meeting.best_lines(texts, items, **s).collect()), key=repr) for s in ({}, sizes))
    assert whole == cut and len(whole) > 40


def test_best_lines_of_nothing(spark, tables):
    texts, items = sides(spark, tables, F.lower)
    for some, few in ((texts, items.limit(0)), (texts.limit(0), items), (texts, items.withColumn("text", F.lit("nowhere")))):
        assert not meeting.best_lines(some, few).collect()
    with pytest.raises(ValueError):
        meeting.best_lines(texts, items, least=5)


def test_token_pairs_agree_with_sql_for_every_row(spark, tables):
    """Of a repeated doc_id each row is a document of its own: their tokens are not added up."""
    got = catalogue.QUERIES["token_pairs_by_content"](spark, tables)
    assert "Join" not in plan(got)
    rows = sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got.select("doc_id", "item_id", "overlap", "jaccard").collect()], key=repr)
    assert rows == oracle(tables, "token_pairs_by_content") and any(len([r for r in rows if r[:2] == (5, i)]) > 1 for i in range(60))


@pytest.mark.parametrize("sizes", [{"items_a_block": 7}, {"chars_a_block": 300}])
def test_shared_words_of_many_blocks(spark, tables, sizes):
    texts, items = sides(spark, tables, lambda c: F.lower(F.trim(c)))
    want = sorted(map(tuple, meeting.shared_words(texts, items).collect()), key=repr)
    assert sorted(map(tuple, meeting.shared_words(texts, items, **sizes).collect()), key=repr) == want


def test_texts_are_counted_in_parts_of_a_batch(monkeypatch):
    items, said, keys = pa.array([1, 2, 3]), ["a b", "b c", "zz"], pa.array(range(50))
    batch = pa.RecordBatch.from_arrays([keys, pa.array([("a b c", "b x", "no", "")[i % 4] for i in range(50)])], ["key", "text"])
    monkeypatch.setattr(meeting, "CELLS", 12)
    parts = list(meeting._shared_words(items, said)(batch))
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    want = [(item, k, c, n, 2) for k in range(50) for item, c, n in ([(1, 2, 3), (2, 2, 3)], [(1, 1, 2), (2, 1, 2)], [], [])[k % 4]]
    assert len(parts) > 5 and sorted(rows) == sorted(want) and not list(meeting._shared_words(items, said)(None))


def test_accents_go_as_in_a_column(spark):
    texts = [ACCENTED, "ÀÉ straße ﬁ", "plain", "", "日本 ação", "ǆ ǅ ḃẛ"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower(F.trim("t")).alias("low"), accent_fold("t").alias("want")).collect():
        assert unaccented(r["low"]) == r["want"]


def test_shares_are_rounded_as_round_does(spark):
    pairs = spark.range(1, 2001).withColumnRenamed("id", "of").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("of"), F.lit(7)))).selectExpr("cast(of as int) of", "cast(c as int) c")
    assert not pairs.where("((2000000L * c + of) div (2L * of)) / 1000000D <> round(c / of, 6)").count()
