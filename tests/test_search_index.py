"""The inverted index beside the search that reads all texts."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.functions.text import tokens as search_tokens
from cartulary.operators import readmodel
from cartulary.operators.search_index import Index

WORDS = "the and die les bathe andes missing ação acao Dr silva x1 日本 a".split()
QUERIES = ["the and die les missing", "the and", "die", "Ação", "dr. silva", "the the and", "he an", "absent", "", "日本", "  A  ", "the, and", "missing the", "x1"]


def documents(spark):
    r = random.Random(5)
    rows = [(i, r.choice([" ", ", ", ". "]).join(r.choice(WORDS) for _ in range(r.randint(1, 9)))) for i in range(300)]
    rows += [(None, "the and die"), (5, "another the and text of five"), (301, None), (302, ""), (303, "bathe andes" + " z" * 200), rows[0], (304, "the and die les missing " * 400)]
    return spark.createDataFrame([(*x, "own") for x in rows], "id long, said string, row string")


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(documents(spark), "id", "said", buckets=4, block=40)


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("limit", [3, 500])
def test_as_a_scan(spark, index, query, limit):
    want = readmodel.search(documents(spark).distinct(), "id", "said", query, limit).collect()
    got = index.search(query, limit).collect()
    assert [(r["key"], r["score"]) for r in got] == [(r["id"], r["score"]) for r in want]
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_documents_that_come_later(spark, tmp_path):
    docs = documents(spark)
    index = Index.build(docs.where("id < 100"), "id", "said", f"{tmp_path}/index", buckets=4, block=10)
    index.add(docs.where("id < 200"), "id", "said", block=10)  # half of them are known
    index.add(docs.where("id >= 200"), "id", "said")
    for query in QUERIES[:5]:
        assert list(map(tuple, index.search(query, 40).collect())) == list(map(tuple, readmodel.search(docs.distinct(), "id", "said", query, 40).collect()))


def test_only_the_folders_of_the_words_are_read(index):
    plan = index.postings(["missing"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,missing)]" in plan
    assert index.postings(["the"]).count() > 1 and index.postings(["the"]).agg(F.max("n_docs")).first()[0] < 80  # blocks, not one list


def test_many_searches_at_once(spark, index):
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "q long, words string")
    got = {(r["query"], r["rank"]): (r["key"], r["score"]) for r in index.search_many(queries, "q", "words", 4).collect()}
    docs = [(r["id"], set(r["t"])) for r in documents(spark).distinct().where("id IS NOT NULL").select("id", F.expr("coalesce(said, '')").alias("s")).select("id", search_tokens("s").alias("t")).collect()]
    for q, text in enumerate(QUERIES):
        wanted = set(spark.range(1).select(search_tokens(F.lit(text))).first()[0])
        best = sorted(((-len(wanted & t) / len(wanted), i) for i, t in docs if wanted & t and len(wanted & t) / len(wanted) >= 0.15), key=lambda x: x)[:4] if wanted else []
        assert [got[q, k + 1] for k in range(len(best))] == [(i, round(-s, 6)) for s, i in best] and (q, len(best) + 1) not in got


def test_postings_of_many_searches_are_dealt_out_once(spark, index):
    """Lists are shuffled by their block, and no longer pair by pair of a search and a document."""
    queries = spark.createDataFrame([(1, "the and les"), (2, "dr silva")], "q int, said string")
    found = index.search_many(queries, "q", "said")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block#" in plan and not any("key#" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line.split("[")[0])
    assert {r["query"] for r in found.collect()} == {1, 2} and "folded" not in index._read("texts").columns


def test_lists_hold_numbers_and_come_whole_from_their_tasks(spark, index):
    """A posting is a small number beside its count; the keys stand once a block, in order, and no block is longer than was asked."""
    lists, keys = index.postings(["the"]).collect(), {r["block"]: r for r in index._keys().collect()}
    assert "keys" not in {f for r in lists for f in r.asDict() if r[f] is not None} and all(len(r["nos"]) == len(r["ns"]) == r["n_docs"] and r["nos"] == sorted(r["nos"]) for r in lists)
    assert all(len(r["keys"]) <= 40 and r["keys"] == sorted(r["keys"]) for r in keys.values()) and all(max(r["nos"]) < len(keys[r["block"]]["keys"]) for r in lists)
    got = sorted(keys[r["block"]]["keys"][i] for r in lists for i in r["nos"])
    want = documents(spark).distinct().where("id IS NOT NULL").select("id", F.expr("coalesce(said, '')").alias("s")).where(F.array_contains(search_tokens("s"), "the"))
    assert got == sorted(r["id"] for r in want.collect())


def test_phrases_of_many_matching_words_are_found_too(spark, index, monkeypatch):
    """Where more words match the ends of a phrase than are named, each posting is tested."""
    from cartulary.operators import search_index

    want = list(map(tuple, index.search("he an", 40).collect()))
    monkeypatch.setattr(search_index, "NAMED", 0)
    assert want and list(map(tuple, index.search("he an", 40).collect())) == want
