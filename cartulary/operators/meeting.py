"""A large table of texts beside a small one of items: every text meets every item, without a row a shared word.

Items are dealt to all tasks in blocks of bounded size, and come before the texts there. A task works their words out once and then reads texts as a
stream, so it holds a block of items and a batch of texts, however many there are; texts are shuffled once a block of items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import unaccented
from ..session import ship

#: Most items of a block, and characters of them, about.
ITEMS, CHARS = 4096, 1 << 22
#: Pairs of a text and an item, and places of shared words, that a task counts at once, about.
CELLS, PLACES = 1 << 18, 1 << 21
_TOKEN = re.compile("[a-z0-9]+")
#: What a task does: (item keys, item texts) to a function of batches of texts (key, text), called at last with None.
Work = Callable[[pa.Array, list[str]], Callable[[pa.RecordBatch | None], Iterator[pa.RecordBatch]]]


def meet(texts: DataFrame, items: DataFrame, work: Work, found: dict[str, T.DataType], items_a_block: int = ITEMS, chars_a_block: int = CHARS) -> DataFrame:
    """What ``work`` finds between texts(key, text) and items(item, text): columns item, key and those of ``found``. Rows without a text meet nothing."""
    ship(texts.sparkSession)
    texts, items = texts.where(F.col("text").isNotNull()), items.where(F.col("text").isNotNull())
    n, chars = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-n // items_a_block), -(-(chars or 0) // chars_a_block))
    parts = max(4 * texts.sparkSession.sparkContext.defaultParallelism, 2 * texts.rdd.getNumPartitions())
    key, item = texts.schema["key"].dataType, items.schema["item"].dataType
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    small = items.select(F.lit(0).alias("kind"), "item", F.lit(None).cast(key).alias("key"), "text", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    large = texts.select(F.lit(1).alias("kind"), F.lit(None).cast(item).alias("item"), "key", "text", every(blocks).alias("block"), F.pmod(F.xxhash64("key", "text"), F.lit(parts)).cast("int").alias("part"))
    both = small.unionByName(large).withColumn("at", F.col("block") * parts + F.col("part")).select("kind", "item", "key", "text", "at")
    dealt = both.repartitionById(blocks * parts, "at").sortWithinPartitions("kind").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, said, ready = [], [], None
        for batch in batches:
            first = batch.num_rows - pc.sum(batch.column("kind")).as_py()
            if first:
                keys.append(batch.column("item").slice(0, first))
                said += batch.column("text").slice(0, first).to_pylist()
            if first < batch.num_rows and said:
                ready = ready or work(pa.concat_arrays(keys), said)
                yield from ready(batch.select(["key", "text"]).slice(first))
        if ready:
            yield from ready(None)

    return dealt.mapInArrow(run, T.StructType([T.StructField("item", item), T.StructField("key", key), *(T.StructField(k, v) for k, v in found.items())]))


def _shared_words(items: pa.Array, said: list[str]):
    """Sums of rows of the table of words by items, for the words of each text."""
    cut = lambda low: set(_TOKEN.findall(unaccented(low)))
    sets = [cut(t) for t in said]
    words = {w: i for i, w in enumerate(set().union(*sets))}
    pairs = np.array([(words[w], i) for i, s in enumerate(sets) for w in s], np.int64).reshape(-1, 2)
    owners, lengths = pairs[np.argsort(pairs[:, 0], kind="stable"), 1], np.bincount(pairs[:, 0], minlength=len(words))
    starts, sizes, known, n = np.cumsum(lengths) - lengths, np.array([len(s) for s in sets], np.int32), frozenset(words), len(sets)
    longest = int(lengths.max(initial=1))

    def counted(keys: pa.Array, hits: list[int], n_hits: list[int], n_words: list[int]) -> pa.RecordBatch:
        at = np.array(hits, np.int64)
        many = lengths[at]
        places = np.repeat(starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells = np.repeat(np.repeat(np.arange(len(n_hits)) * n, n_hits), many) + owners[places]
        shared = np.bincount(cells, minlength=n * len(n_hits))
        some = np.flatnonzero(shared)
        text, item = some // n, some % n
        columns = [items.take(pa.array(item)), keys.take(pa.array(text)), pa.array(shared[some].astype(np.int32)), pa.array(np.array(n_words, np.int32)[text]), pa.array(sizes[item])]
        return pa.RecordBatch.from_arrays(columns, ["item", "key", "c", "n", "m"])

    def run(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        start, hits, n_hits, n_words = 0, [], [], []
        for i, text in enumerate(batch.column("text") if batch else ()):
            found = cut(text.as_py())
            shared = found & known
            hits += [words[w] for w in shared]
            n_hits.append(len(shared))
            n_words.append(len(found))
            if len(n_hits) * n >= CELLS or len(hits) * longest >= PLACES or i + 1 == batch.num_rows:
                yield counted(batch.column("key").slice(start, i + 1 - start), hits, n_hits, n_words)
                start, hits, n_hits, n_words = i + 1, [], [], []

    return run


def shared_words(texts: DataFrame, items: DataFrame, **sizes: int) -> DataFrame:
    """(item, key, c, n, m) for each of texts(key, text) beside each of items(item, text) that shares a word with it: the distinct words that they share,
    those of the text and those of the item. Texts are trimmed and lower case, words runs of a-z and digits when accents are off."""
    return meet(texts, items, _shared_words, {"c": T.IntegerType(), "n": T.IntegerType(), "m": T.IntegerType()}, **sizes)


def _spare(n: int) -> int:
    """How many words of the smaller set a pair of a line and an item may lack: a fifth, or the two that a containing text may cut."""
    return max(n // 5, 2)


def _best_lines(least: float):
    """A pair that counts shares one of any spare + 1 words of the smaller side. So the rarest of either side are sought among all words of the other;
    a line with more unknown words than it has to spare seeks none."""

    def work(items: pa.Array, said: list[str]):
        sets = [set(t.split(" ")) - {""} for t in said]
        owners: dict[str, list[int]] = {}
        for i, s in enumerate(sets):
            for w in s:
                owners.setdefault(w, []).append(i)
        rarest = lambda words, k: sorted(words, key=lambda w: (len(owners[w]), -len(w), w))[:k]
        marks: dict[str, list[int]] = {}
        for i, s in enumerate(sets):
            for w in rarest(s, _spare(len(s)) + 1):
                marks.setdefault(w, []).append(i)
        known, marked, best = frozenset(owners), frozenset(marks), {}

        def score(line: str, words: set[str], i: int) -> float:
            shared, small = len(words & sets[i]), min(len(words), len(sets[i]))
            more = 20 if line == said[i] else 10 if line in said[i] or said[i] in line else 0
            return more + 10 * shared / small

        kind = pa.null()

        def run(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            if batch is None:
                costs, _, keys, nos = zip(*best.values()) if best else [()] * 4
                columns = [items.take(pa.array(best, pa.int64())), pa.array(keys, kind), pa.array([-c for c in costs], pa.float64()), pa.array(nos, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "key", "score", "line_no"])
                return
            kind = batch.column("key").type
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                for no, line in enumerate(text.as_py().split("\n")):
                    words = set(line.split(" "))
                    words.discard("")
                    shared = words & known
                    if not shared:
                        continue
                    near = {i for w in shared & marked for i in marks[w]}
                    if (left := _spare(len(words)) + 1 - len(words) + len(shared)) > 0:
                        near.update(i for w in (shared if left >= len(shared) else rarest(shared, left)) for i in owners[w])
                    for i in near:
                        if (s := score(line, words, i)) >= least:
                            place = (-s, key is None, key, no)
                            if i not in best or place < best[i]:
                                best[i] = place

        return run

    return work


def best_lines(texts: DataFrame, items: DataFrame, least: float = 8, **sizes: int) -> DataFrame:
    """(item, key, line_no, score): for each of items(item, text) the line of texts(key, text) that matches it best, from a score of at least 8 on; ties
    by key and line. A pair shares a word; equal ones have 20 points, one that contains the other 10, and 10 times the shared words of the smaller set are
    added. Both sides are lower case, words what spaces part."""
    if least < 8:
        raise ValueError("below a score of 8 more words may be missing than are sought")
    found = meet(texts, items, _best_lines(least), {"score": T.DoubleType(), "line_no": T.LongType()}, **sizes)
    first = found.groupBy("item").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("key").isNull().alias("none"), "key", "line_no")).alias("b"))
    return first.select("item", "b.key", "b.line_no", (-F.col("b.s")).alias("score"))
