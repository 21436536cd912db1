"""Operator 2: sharding by k-d tree partitioning.

A cell of documents is split at the weighted median (weights are bytes) of its widest metadata dimension, until there
are as many leaves as shards, or every leaf holds the target bytes at most. The median is found by counting: all
cells of a level share one aggregation a round, each round narrows the bracket of each median by BINS, and what comes
to the driver is cells x BINS sums whatever the number of documents. Rows that tie in the dimension are ordered by
key, so the cut falls between two documents and the halves are equal but for one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_path, shuffle_partitions, utf8_size

BINS = 1024
#: Cells whose medians are sought at once: what a round brings to the driver is at most so many times BINS sums, and
#: what it sends is a row a cell. A level of more cells is split in several goes.
MOST_CELLS = 4096


def metadata(docs: DataFrame, key: str = "doc_id") -> dict[str, Column]:
    """The dimensions of documents: non-negative whole numbers. Text columns are placed by their first bytes."""
    return {"size": F.col("size"), "source": _spread("source"), "lang": _spread("lang"), "place": F.col(key)}


def _spread(name: str) -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("string")), F.lit(0))


class _Search:
    """The bracket [lo, hi] of one cell's median: first among values of its dimension, then among keys of the rows that
    tie at the median. left: the weight that the lower part takes from inside the bracket."""

    def __init__(self, by: str, lo: int, hi: int, left: float):
        self.by, self.lo, self.hi, self.left, self.value = by, lo, hi, left, None

    @property
    def step(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // BINS))

    def row(self, cell: int) -> tuple:
        """The bracket as a row of the table of searches."""
        return cell, self.by, self.value, self.lo, self.hi, self.step

    def narrow(self, sums: list[tuple[int, int]], keys: tuple[int, int]) -> int | None:
        """Narrows the bracket to the bin where the weight reaches left; the last key of the lower part, once found."""
        below, step = 0, self.step
        for b, w in sums:
            if below + w >= self.left or b == sums[-1][0]:
                break
            below += w
        self.left -= below
        self.lo, self.hi = self.lo + b * step, min(self.hi, self.lo + (b + 1) * step - 1)
        if step > 1:
            return None
        if self.value is None:
            self.value, (self.lo, self.hi) = self.lo, keys
            return None
        return self.lo if w - self.left <= self.left else self.lo - 1


def _dimension(names: list[str]) -> Column:
    """The value of the dimension that column ``by`` names."""
    out = F.when(F.col("by") == names[0], F.col(names[0]))
    for name in names[1:]:
        out = out.when(F.col("by") == name, F.col(name))
    return out


def _medians(rows: DataFrame, searches: dict[int, _Search], keys: tuple[int, int]) -> dict[int, tuple[int, int]]:
    """rows(cell, key, weight, dimensions) -> for each cell the greatest (value, key) of its lower part, which weighs as
    near to the wanted weight as any."""
    done: dict[int, tuple[int, int]] = {}
    spark, dimensions = rows.sparkSession, sorted({s.by for s in searches.values()})
    while searches:
        table = spark.createDataFrame([s.row(c) for c, s in searches.items()], "cell long, by string, value long, lo long, hi long, step long")
        met = rows.join(F.broadcast(table), "cell")  # MOST_CELLS rows at most
        found = _dimension(dimensions)
        sought = F.when(F.col("value").isNull(), found).otherwise(F.col("key"))
        here = sought.between(F.col("lo"), F.col("hi")) & (F.col("value").isNull() | (found == F.col("value")))
        bins = met.where(here).groupBy("cell", F.call_function("div", sought - F.col("lo"), F.col("step")).alias("bin")).agg(F.sum("weight").alias("w"))
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in bins.collect():
            sums.setdefault(r[0], []).append((r[1], r[2]))
        for c in list(searches):
            if (key := searches[c].narrow(sorted(sums[c]), keys)) is not None:
                done[c] = (searches.pop(c).value, key)
    return done


def tree_leaves(rows: DataFrame, dimensions: list[str], shards: int | None, target: int | None) -> DataFrame:
    """rows(key, weight, dimensions) -> rows with ``cell``: the number of the leaf, in the order of the tree."""
    rows = rows.withColumn("cell", F.lit(0).cast("long"))
    wanted: dict[int, int] = {0: shards or 0}
    low, high, *spans = rows.agg(F.min("key"), F.max("key"), *[F.max(d) - F.min(d) for d in dimensions]).first()
    whole = {d: max(s or 0, 1) for d, s in zip(dimensions, spans)}
    while True:
        stats = {
            r["cell"]: r
            for r in rows.groupBy("cell").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), *[f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)]).collect()
        }
        cells = {}
        for c, r in stats.items():
            parts = wanted.get(c, 0) if shards else 2 * (r["weight"] > target)
            if parts < 2 or r["n"] < 2 or len(cells) >= MOST_CELLS:
                continue
            by = max(dimensions, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d])
            cells[c] = _Search(by, r[f"min_{by}"], r[f"max_{by}"], r["weight"] * (parts // 2) / parts)
        if not cells:
            break
        cuts = _medians(rows, dict(cells), (low, high))
        for c in cuts if shards else ():
            wanted[2 * c + 1], wanted[2 * c + 2] = wanted[c] // 2, wanted[c] - wanted[c] // 2
        table = rows.sparkSession.createDataFrame([(c, cells[c].by, value, key) for c, (value, key) in cuts.items()], "cell long, by string, cut long, cut_key long")
        by = _dimension(dimensions)
        side = F.when((by < F.col("cut")) | ((by == F.col("cut")) & (F.col("key") <= F.col("cut_key"))), 1).otherwise(2)
        split = F.when(F.col("by").isNull(), F.col("cell")).otherwise(2 * F.col("cell") + side)
        # A level is a table of its own, so the plan stays as small as its first one.
        rows = materialise(rows.join(F.broadcast(table), "cell", "left").select(*[c for c in rows.columns if c != "cell"], split.alias("cell")), "cells")
    return rows


def _in_order(cells: list[int]) -> list[int]:
    """Leaves from left to right: by the path from the root."""

    def path(c: int) -> list[int]:
        steps = []
        while c:
            steps.append((c - 1) % 2)
            c = (c - 1) // 2
        return steps[::-1]

    return sorted(cells, key=path)


def slots(rows: DataFrame, shard: str, order: str) -> DataFrame:
    """rows with ``slot``: gapless numbers from 0 within each shard. Rows are dealt by ranges of (shard, order); a task
    numbers its own, and starts from counts of (task, shard), of which there are a few a task."""
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(shuffle_partitions(spark), shard, order).sortWithinPartitions(shard, order)
    at = materialise(sorted_rows.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.spark_partition_id()), "shards")
    found = at.groupBy("__p", shard).agg(F.min("__m").alias("first"), F.count("*").alias("n")).collect()
    base, total = [], {}
    for r in sorted(found, key=lambda r: (r[shard], r["__p"])):
        base.append((r["__p"], r[shard], r["first"], total.get(r[shard], 0)))
        total[r[shard]] = total.get(r[shard], 0) + r["n"]
    starts = spark.createDataFrame(base, f"__p int, {shard} int, __first long, __base long")
    return at.join(F.broadcast(starts), ["__p", shard]).withColumn("slot", F.col("__m") - F.col("__first") + F.col("__base")).drop("__p", "__m", "__first", "__base")


def assign(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, key: str = "doc_id", column: str = "text", dimensions: dict[str, Column] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: key, size (UTF-8 bytes and one), text_crc32, shard, slot, and the columns to carry. Give shards, or target_bytes for leaves.

    Null texts have size 1 and checksum 0, as empty ones. Null keys come before all others. Equal rows may part: bytes
    bind, not copies. Rows that tie in everything but their place in the table are parted by no rule. Texts of any length
    count with their bytes alone. Other columns of docs are not read, so their names can't clash. Shards that get no row (fewer rows than shards) stay empty. Documents are single units, so a
    shard's bytes differ from its share by less than the documents at its cuts. An empty table gives an empty result."""
    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("key"), F.col(key).cast("long").alias("own"), (utf8_size(column) + 1).alias("size"), F.crc32(F.coalesce(F.col(column), F.lit(""))).alias("text_crc32"), *[c for c in ("source", "lang") if c in docs.columns], *carry)
    made = dimensions or {d: c for d, c in metadata(named, "key").items() if d not in ("source", "lang") or d in named.columns}
    rows = named.select("key", "own", "text_crc32", *carry, F.col("size").alias("weight"), *[c.cast("long").alias(f"d_{d}") for d, c in made.items()])
    rows = materialise(rows, "metadata")
    placed = tree_leaves(rows, [f"d_{d}" for d in made], shards, target_bytes)
    order = _in_order([r[0] for r in placed.select("cell").distinct().collect()])
    numbers = docs.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "cell long, shard int")
    placed = placed.join(numbers, "cell")  # Spark broadcasts the table of leaves if it is small
    out = slots(placed.select("own", "key", F.col("weight").alias("size"), "text_crc32", *carry, "shard"), "shard", "key")
    return out.select(F.col("own").alias(key), "size", "text_crc32", "shard", "slot", *carry)


def write_shards(docs: DataFrame, path: str | None = None, shards: int | None = 8, target_bytes: int | None = None, key: str = "doc_id", column: str = "text") -> str:
    """The documents themselves, one folder a shard, in the order of their slots. Rows are told apart by numbers of their
    own, so those with null or repeated keys are written once each. Columns shard and slot of docs are replaced."""
    path = path or scratch_path(docs.sparkSession, "shards")
    rows = materialise(docs.drop("shard", "slot").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    placed = assign(rows, shards, target_bytes, key, column, carry=("__row",)).select("__row", "shard", "slot")
    out = rows.join(placed, "__row").drop("__row")
    out.repartitionByRange(shuffle_partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def shard_report(docs: DataFrame) -> DataFrame:
    """assign() to eight shards under the law of bytes, with the columns of the contract."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

