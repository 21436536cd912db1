"""An inverted index for text search, as three tables in one folder.

* ``postings``: a row a word and block of documents, with the documents' numbers in the block and the word's counts in them; in folders by the hash of the
  word, sorted by word, so a search reads the folders of its words and skips the rest of them by their statistics. A row without a word holds the keys of a
  block's documents by their numbers, which ascend with the keys: lists of numbers below some thousand take a fraction of the room of lists of keys.
* ``terms``: words with the number of documents that have them, in folders likewise.
* ``texts``: documents by the hash of their key, for what a posting can't say: whole phrases and snippets.

A block is a run of documents that one task reads: it turns them into lists of its own, which are shuffled as they are and not merged, so no list
is longer than the documents of a block, however common its word. Documents are added by segments, which are read together.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ACCENTED, PLAIN, accent_fold, snippet, tokens, unaccented
from ..session import kept_path, ship

#: Folders of words and of documents, and most documents of a block. A block also ends with the document that fills so many places of its lists.
BUCKETS, BLOCK, PLACES = 32, 4096, 1 << 20
#: Words that a search names when it reads their postings; where more match, it reads all words' and tests each.
NAMED = 1000
#: Fixed value: what a whole phrase adds to the share of words.
PHRASE = 0.25
TABLES = ("texts", "postings", "terms")
_TOKEN = re.compile("[a-z0-9]+")


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def inverted(block: int, places: int = PLACES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trimmed lower-case texts (key, row, text) to lists of the documents that have a word, for each word of a block, and the block's keys. A block is named after its first row."""

    def lists(docs: list[pa.RecordBatch], words: dict[str, int], codes: list[int], counts: list[int], sizes: list[int]) -> pa.RecordBatch:
        held, by = pa.Table.from_batches(docs), np.array(codes, np.int32)
        name, ranked = held.column("row")[0], pc.sort_indices(held, [("key", "ascending"), ("row", "ascending")])
        rank = np.empty(held.num_rows, np.int32)
        rank[ranked.to_numpy()] = np.arange(held.num_rows, dtype=np.int32)
        nos = np.repeat(rank, sizes)
        order = np.lexsort((nos, by))
        ends = np.concatenate([[0], np.cumsum(np.bincount(by, minlength=len(words)))]).astype(np.int32)
        whole = lambda values: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.nulls(len(words), pa.list_(values.type))])
        listed = lambda values: pa.ListArray.from_arrays(pa.array([None, *ends], pa.int32()), pa.array(values[order]))
        keys, rows = (held.column(c).combine_chunks().take(ranked) for c in ("key", "row"))
        columns = [pa.array([None, *words], pa.string()), pa.array(np.full(len(words) + 1, name.as_py())), whole(keys), whole(rows), listed(nos), listed(np.array(counts, np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["token", "block", "keys", "rows", "nos", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, codes, counts, sizes = [], {}, [], [], []
        for batch in batches:
            start, rows = 0, batch.select(["key", "row"])
            for i, text in enumerate(batch.column("text")):
                found = Counter(_TOKEN.findall(unaccented(text.as_py())))
                codes += [words.setdefault(w, len(words)) for w in found]
                counts += found.values()
                sizes.append(len(found))
                if len(sizes) >= block or len(codes) >= places:
                    docs.append(rows.slice(start, i + 1 - start))
                    if codes:
                        yield lists(docs, words, codes, counts, sizes)
                    start, docs, words, codes, counts, sizes = i + 1, [], {}, [], [], []
            if start < batch.num_rows:
                docs.append(rows.slice(start))
        if codes:
            yield lists(docs, words, codes, counts, sizes)

    return run


def words_of(query: str) -> tuple[str, Counter]:
    """The folded query, and its words with how often each stands in it."""
    phrase = query.strip().lower().translate(str.maketrans(ACCENTED, PLAIN))
    return phrase, Counter(re.findall("[a-z0-9]+", phrase))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @staticmethod
    def build(docs: DataFrame, key: str, text: str, path: str | None = None, buckets: int = BUCKETS, block: int = BLOCK) -> Index:
        """The index of docs(key, text). Rows without a key are left out, equal rows count once, and of a repeated key each text
        is found by itself. A null text is an empty one."""
        index = Index(docs.sparkSession, path or kept_path(docs.sparkSession, "index"), buckets)
        return index.add(docs, key, text, block, known=False)

    def add(self, docs: DataFrame, key: str, text: str, block: int = BLOCK, known: bool = True) -> Index:
        """One more segment of rows that the index doesn't have yet; ``known`` False: it has none. A segment's folders are named after it,
        and what is there is not touched."""
        segment = uuid.uuid4().hex
        at = {t: f"{self.path}/{t}/segment={segment}" for t in TABLES}
        # A row's number is a hash of what it holds, so it is the same whenever it is computed.
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        rows = rows.withColumn("row", F.xxhash64("key", "text")).withColumn("bucket", _bucket(F.col("row"), self.buckets))
        parts = self._parts(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        once = self._dealt(rows, "row", parts).dropDuplicates(["bucket", "row", "key", "part"]).drop("part")
        if known:
            once = once.join(self._read("texts").select("bucket", "key", "row"), ["bucket", "key", "row"], "left_anti")
        once.sortWithinPartitions("bucket", "row").write.partitionBy("bucket").option("compression", "zstd").parquet(at["texts"])
        # A row is one document, so lists are made where it is read, and shuffled once: lists, not their places one by one.
        ship(self.spark)
        said = self.spark.read.parquet(at["texts"]).select("key", "row", F.lower(F.trim("text")).alias("text"))
        kinds = {"token": T.StringType(), "block": T.LongType(), "keys": T.ArrayType(said.schema["key"].dataType), "rows": T.ArrayType(T.LongType()), "nos": T.ArrayType(T.IntegerType()), "ns": T.ArrayType(T.IntegerType())}
        made = said.mapInArrow(inverted(block), T.StructType([T.StructField(k, v) for k, v in kinds.items()])).withColumn("by", F.coalesce("token", F.col("block").cast("string")))
        made = self._dealt(made.withColumn("bucket", _bucket(F.col("by"), self.buckets)), "by", max(parts, self._parts(2 * said.rdd.getNumPartitions()))).drop("part", "by").withColumn("n_docs", F.size("nos"))
        made.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(at["postings"])
        terms = self.spark.read.parquet(at["postings"]).where(F.col("token").isNotNull()).select("bucket", "token", "n_docs").repartition("bucket").groupBy("bucket", "token").agg(F.sum("n_docs").alias("n_docs"))
        terms.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(at["terms"])
        return self

    def _parts(self, tasks: int) -> int:
        """The parts of a folder for that many tasks, or some more."""
        return max(1, -(-tasks // self.buckets))

    def _dealt(self, df: DataFrame, by: str, parts: int) -> DataFrame:
        """df with each folder's rows cut into parts by a hash; a part goes to one task and one file."""
        part = F.col("bucket") * parts + F.pmod(F.shiftright(F.xxhash64(by), 20), F.lit(parts)).cast("int")
        return df.withColumn("part", part).repartitionById(self.buckets * parts, "part")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("segment")

    def postings(self, words: list[str]) -> DataFrame:
        """The postings of these words; other folders are not read, and within them only the row groups that may hold the words."""
        return self._read("postings").where(F.col("bucket").isin(*self._folders(words)) & F.col("token").isin(*words))

    def _postings_where(self, test: Column) -> DataFrame:
        """The postings of the words that a test on the token holds for."""
        words = [r["token"] for r in self._read("terms").where(test).select("token").distinct().limit(NAMED + 1).collect()]
        return self.postings(words) if len(words) <= NAMED else self._read("postings").where(test)

    @staticmethod
    def _places(postings: DataFrame, *more: Column | str) -> DataFrame:
        """(block, no), and more columns, of each document in the lists of these postings."""
        return postings.select("block", F.explode("nos").alias("no"), *more)

    def _keys(self) -> DataFrame:
        """(block, keys, rows): what the numbers of a block stand for."""
        return self._read("postings").where(F.col("token").isNull()).select("block", "keys", "rows")

    def _documents(self, places: DataFrame) -> DataFrame:
        """Rows of (block, no) with the key and row of the document instead."""
        known = self._keys().select("block", F.posexplode(F.arrays_zip("keys", "rows")).alias("no", "d")).select("block", "no", F.col("d.keys").alias("key"), F.col("d.rows").alias("row"))
        return places.join(known, ["block", "no"]).drop("block", "no")

    def _folders(self, words: list[str]) -> list[int]:
        return sorted({r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"), self.buckets)).collect()})

    def terms(self) -> DataFrame:
        return self._read("terms").groupBy("bucket", "token").agg(F.sum("n_docs").alias("n_docs"))

    def texts(self, rows: DataFrame) -> DataFrame:
        """The documents of rows(key, row)."""
        keys = rows.select("key", "row", _bucket(F.col("row"), self.buckets).alias("bucket"))
        return self._read("texts").join(keys, ["bucket", "key", "row"], "left_semi")

    def phrase_rows(self, phrase: str, words: list[str]) -> DataFrame:
        """(key, row) of the documents whose folded text holds the phrase. A phrase may begin and end within a word: candidates have words that end
        with its first, begin with its last and equal those between; their texts decide."""
        ordered = re.findall("[a-z0-9]+", phrase)
        t = F.col("token")
        if len(ordered) == 1:
            tests = {"only": F.contains(t, F.lit(ordered[0]))}
        else:
            tests = {"first": F.endswith(t, F.lit(ordered[0])), "last": F.startswith(t, F.lit(ordered[-1]))}
        wide = None
        for name, test in tests.items():
            found = self._places(self._postings_where(test)).withColumn("part", F.lit(name))
            wide = found if wide is None else wide.unionByName(found)
        inner = sorted(set(ordered[1:-1]))
        if inner:
            wide = wide.unionByName(self._places(self.postings(inner), F.concat(F.lit("="), "token").alias("part")))
        pairs = wide.groupBy("block", "no").agg(F.count_distinct("part").alias("n"))
        candidates = self._documents(pairs.where(F.col("n") == len(tests) + len(inner)).select("block", "no"))
        return self.texts(candidates).where(F.contains(accent_fold("text"), F.lit(phrase))).select("key", "row")

    def search(self, query: str, limit: int = 20, least: float = 0.15) -> DataFrame:
        """(key, score, snippet): as readmodel.search over the same documents, where equal rows count once. Texts are read of the documents found, not of
        all."""
        phrase, wanted = words_of(query)
        if not wanted:
            return self._read("texts").limit(0).select("key", F.lit(0.0).alias("score"), "text").withColumnRenamed("text", "snippet")
        times = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
        hits = self._places(self.postings(list(wanted)), times[F.col("token")].alias("times")).groupBy("block", "no").agg(F.sum("times").alias("hits"))
        hits = self._documents(hits).withColumn("bonus", F.lit(0.0))
        whole = self.phrase_rows(phrase, list(wanted)).select("key", "row", F.lit(0).cast("long").alias("hits"), F.lit(PHRASE).alias("bonus"))
        scored = hits.unionByName(whole).groupBy("key", "row").agg(F.least(F.lit(1.0), F.sum("hits") / F.lit(wanted.total()) + F.max("bonus")).alias("score"))
        top = scored.where(F.col("score") >= least).orderBy(F.col("score").desc(), "key", "row").limit(max(1, limit))
        texts = self._read("texts")
        found = texts.join(F.broadcast(top.withColumn("bucket", _bucket(F.col("row"), self.buckets))), ["bucket", "key", "row"])  # at most ``limit`` rows
        return found.select("key", F.round("score", 6).alias("score"), snippet(F.col("text"), F.lit(query)).alias("snippet")).orderBy(F.col("score").desc(), "key")

    def search_many(self, queries: DataFrame, key: str, text: str, limit: int = 5, least: float = 0.15) -> DataFrame:
        """(query, key, score, rank): the best documents of each of queries(key, text) by the share of its distinct words, ties by key.
        The lists of the words that are asked are dealt out once, by their block: all words of a document are there, so counts need no further
        shuffle, and a query's best rows are kept within each task first."""
        asked = queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(tokens(text))).alias("token"), F.size(F.array_distinct(tokens(text))).alias("of"))
        asked = asked.groupBy("token").agg(F.collect_list(F.struct("query", "of")).alias("asks")).withColumn("bucket", _bucket(F.col("token"), self.buckets))
        lists = self._read("postings").join(asked, ["bucket", "token"]).select("block", "asks", "nos")
        hits = self._places(lists.repartition("block").select("block", F.explode("asks").alias("a"), "nos"), "a.query", "a.of")
        counted = hits.groupBy("block", "query", "no").agg((F.count("*") / F.max("of")).alias("score")).where(F.col("score") >= least)
        # Numbers ascend with keys, so a block's best are known before their keys are.
        near = Window.partitionBy("block", "query").orderBy(F.col("score").desc(), "no")
        few = counted.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= limit).join(self._keys(), "block")
        found = few.select("query", F.col("keys")[F.col("no")].alias("key"), F.col("rows")[F.col("no")].alias("row"), "score")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "key", "row")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query", "key", F.round("score", 6).alias("score"), "rank")
