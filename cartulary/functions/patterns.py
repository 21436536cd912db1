"""Many fixed patterns in one pass over a text, by an automaton over Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Literals and texts of one key that a task matches at once; larger keys are dealt out in cells of so many of both.
CELL = 20_000


@functools.lru_cache(maxsize=64)
def automaton(groups: tuple[tuple[str, ...], ...]) -> ahocorasick.Automaton:
    """Of each word, the groups that hold it, as often as they do."""
    owners: dict[str, list[int]] = {}
    for i, words in enumerate(groups):
        for w in words:
            owners.setdefault(w, []).append(i)
    made = ahocorasick.Automaton()
    for w, groups_of in owners.items():
        made.add_word(w, (w, groups_of))
    made.make_automaton()
    return made


def group_counts(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """An array with the number of each group's words that a text holds, as substrings; zeros for null. The text is read once, whatever the
    number of words; words must not be empty."""
    fixed = tuple(tuple(g) for g in groups)
    if not all(w for g in fixed for w in g):
        raise ValueError("words must not be empty")

    @F.arrow_udf("array<int>")
    def counts(texts: pa.Array) -> pa.Array:
        tool, out = automaton(fixed), []
        for t in texts.to_pylist():
            row, seen = [0] * len(fixed), set()
            for _, (word, owners) in tool.iter(t) if t else ():
                if word not in seen:
                    seen.add(word)
                    for i in owners:
                        row[i] += 1
            out.append(row)
        return pa.array(out, pa.list_(pa.int32()))

    return counts(text)


def literal_pairs(candidates: DataFrame, spans: DataFrame, key: str, cell: int = CELL) -> DataFrame:
    """candidates(key, ord, literal, ...) and spans(key, span_ord, text, ...) -> every pair of one key whose text holds the literal, with all columns
    of both. Null or empty literals, null texts and null keys are in no pair; repeated rows give repeated pairs.

    The rows of a key meet in a task, its candidates first; these make an automaton, and each span is read once. A key of more than ``cell``
    candidates or spans is dealt out in cells, so that no task holds more of one key."""
    ship(candidates.sparkSession)
    left = candidates.where((F.col("literal") != "") & F.col(key).isNotNull())
    right = spans.where(F.col("text").isNotNull() & F.col(key).isNotNull())
    parts = lambda n: F.ceil(F.col(n) / cell).cast("int")
    sizes = left.groupBy(key).agg(F.count("*").alias("__c")).join(right.groupBy(key).agg(F.count("*").alias("__s")), key).select(key, parts("__c").alias("__c"), parts("__s").alias("__s"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda hashed, n: F.pmod(F.xxhash64(*hashed), F.col(n)).cast("int")
    structs = {"c": T.StructType(left.schema.fields), "s": T.StructType(right.schema.fields)}
    a = left.select(key, F.struct(*left.columns).alias("c")).join(sizes, key).withColumn("i", own(["c.literal", "c.ord"], "__c")).withColumn("j", all_of("__s"))
    b = right.select(key, F.struct(*right.columns).alias("s")).join(sizes, key).withColumn("j", own(["s.text", "s.span_ord"], "__s")).withColumn("i", all_of("__c"))
    both = a.select(key, "i", "j", F.lit(0).alias("kind"), "c").unionByName(b.select(key, "i", "j", F.lit(1).alias("kind"), "s"), allowMissingColumns=True)
    dealt = both.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, literals, tool = None, {}, None
        for batch in batches:
            kinds = [batch.schema.field(n).type for n in ("c", "s")]
            pairs: list[tuple] = []
            for at, i, j, kind, c, s in zip(*[batch.column(n).to_pylist() for n in (key, "i", "j", "kind", "c", "s")]):
                if (at, i, j) != now:
                    now, literals, tool = (at, i, j), {}, None
                if kind == 0:
                    literals.setdefault(c["literal"], []).append(c)
                    continue
                if tool is None:
                    tool = ahocorasick.Automaton()
                    for w in literals:
                        tool.add_word(w, w)
                    tool.make_automaton()
                if literals:
                    pairs += [(c, s) for w in {w for _, w in tool.iter(s["text"])} for c in literals[w]]
                if len(pairs) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*pairs), kinds)], ["c", "s"])
                    pairs = []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*pairs), kinds)], ["c", "s"])

    schema = T.StructType([T.StructField(n, k) for n, k in structs.items()])
    return dealt.mapInArrow(run, schema).select("c.*", *[F.col(f"s.{n}") for n in right.columns if n not in left.columns])
