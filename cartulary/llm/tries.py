"""Operator 12: the prefix trie of conversations, by sorted turn arrays and their common prefixes.

A turn is a symbol of 128 bits, a conversation the string of its symbols, so texts don't leave the stage that reads them. The
strings are sorted over the whole cluster by ranges. Within a range one sweep keeps the nodes on the path of the current
conversation on a stack: what lies beyond the common prefix with the next one is closed, and adds its sums to its parent.

Nodes on the path of a range's first and last conversation may go on in other ranges. They are written as partial sums, a path or
two a range, and are stitched by the same stack in one sweep over these partial nodes. Lists of conversations that
end in a node are hashed where they stand; long ones and those at a range's edge are written in blocks and hashed in order. So no group
of conversations, however large, is held at once. A node's parent is joined by its key, as the parent's
smallest member is known only when all its children are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

#: Bytes of a turn's symbol.
SYMBOL = 16
#: Numbers of a block of endings.
BLOCK = 1 << 16
#: Conversations that share their first turns in the query, and the number below which h stays.
HUNDRED, HEADS = 100, 6
NOTHING = sha256(b"").hexdigest()

OUT = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("points", pa.int64()), ("ends", pa.string()), ("blocked", pa.bool_()), ("part", pa.int32()), ("side", pa.int32()), ("symbol", pa.binary()), ("block", pa.int64()), ("ids", pa.binary()),
])
DDL = """kind int, key binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long,
         saved_tokens long, points long, ends string, blocked boolean, part int, side int, symbol binary, block long, ids binary"""
CLOSED, PARTIAL, ENDINGS = 0, 1, 2
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Node:
    """An open node; its sums are of what is closed below it."""

    __slots__ = ("key", "symbol", "points", "left", "least", "n", "children", "leaves", "saved", "ends", "blocked", "blocks")

    def __init__(self, key: bytes, symbol: bytes, points: int, left: bool) -> None:
        self.key, self.symbol, self.points, self.left = key, symbol, points, left
        self.least, self.n, self.children, self.leaves, self.saved, self.ends, self.blocked, self.blocks = None, 0, 0, 0, 0, None, False, 0

    def below(self, symbol: bytes, points: int, left: bool) -> Node:
        return Node(blake2b(self.key + symbol, digest_size=SYMBOL).digest(), symbol, points, left)

    def meet(self, least: int | None, n: int) -> None:
        self.n += n
        if self.least is None or least is not None and least < self.least:
            self.least = least

    def close(self, parent: Node | None) -> None:
        """Makes the sums those of the whole subtree, and adds them to the parent's."""
        self.leaves += self.children == 0
        self.saved += (self.n - 1) * self.points
        if parent is not None:
            parent.meet(self.least, self.n)
            parent.children += 1
            parent.leaves += self.leaves
            parent.saved += self.saved


def root() -> Node:
    return Node(b"", b"", 0, True)


def common(a: bytes, b: bytes) -> int:
    """Symbols that two strings share at their start."""
    if b.startswith(a):
        return len(a) // SYMBOL
    low, high = 0, min(len(a), len(b)) // SYMBOL
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * SYMBOL : mid * SYMBOL] == b[low * SYMBOL : mid * SYMBOL]:
            low = mid
        else:
            high = mid - 1
    return low


class Sweep:
    """The nodes of one range of sorted conversations; ``rows`` gathers what they give, as tuples of OUT."""

    def __init__(self, part: int, block: int = BLOCK) -> None:
        self.part, self.block = part, block
        self.stack, self.now, self.first, self.run, self.rows = [root()], b"", None, array("q"), []

    def add(self, string: bytes, points: list[int], conv: int) -> None:
        if self.first is None:
            self.first = string
        elif string != self.now:
            self.end_run(self.now == self.first)
        shared = common(self.now, string)
        while len(self.stack) > shared + 1:
            self.pop()
        for d in range(shared, len(string) // SYMBOL):
            self.stack.append(self.stack[-1].below(string[d * SYMBOL : (d + 1) * SYMBOL], points[d], string is self.first))
        self.now = string
        self.stack[-1].meet(conv, 1)
        self.run.append(conv)
        if len(self.run) >= self.block:
            self.write_block()

    def write_block(self) -> None:
        node = self.stack[-1]
        self.rows.append((ENDINGS, node.key, *[None] * 10, self.part, None, None, node.blocks, self.run.tobytes()))
        node.blocked, node.blocks, self.run = True, node.blocks + 1, array("q")

    def end_run(self, edge: bool) -> None:
        """The conversations that end in the top node are all known, but for those in other ranges if this is an edge."""
        node = self.stack[-1]
        if not self.run:
            return
        if edge or node.blocked:
            self.write_block()
        else:
            node.ends, self.run = sha256(",".join(map(str, self.run)).encode()).hexdigest(), array("q")

    def pop(self) -> None:
        node = self.stack.pop()
        parent, depth = self.stack[-1], len(self.stack)
        if node.left:
            self.partial(node, parent, depth, 0)
        else:
            node.close(parent)
            self.rows.append((CLOSED, node.key, parent.key, depth, node.least, node.n, node.children, node.leaves, node.saved, node.points, node.ends, node.blocked, *[None] * 5))

    def partial(self, node: Node, parent: Node | None, depth: int, side: int) -> None:
        self.rows.append((PARTIAL, node.key, parent.key if parent else None, depth, node.least, node.n, node.children, node.leaves, node.saved, node.points, node.ends, node.blocked, self.part, side, node.symbol, None, None))

    def finish(self) -> None:
        if self.first is None:
            return
        self.end_run(True)
        for depth, node in enumerate(self.stack):
            self.partial(node, self.stack[depth - 1] if depth else None, depth, 0 if node.left else 1)
        self.stack = []


def _flush(rows: list[tuple]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)
    rows.clear()
    return out


def sweep(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    state = None
    for b in batches:
        for string, points, conv, part in zip(*[b.column(c).to_pylist() for c in ("string", "points", "conv_id", "part")]):
            state = state or Sweep(part, block)
            state.add(string, points, conv)
            if len(state.rows) >= 5_000:
                yield _flush(state.rows)
    if state:
        state.finish()
        yield _flush(state.rows)


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial nodes by range, side and depth, which is the order of a walk down the trie -> whole nodes."""
    stack: list[Node] = []
    rows: list[tuple] = []

    def pop() -> None:
        node = stack.pop()
        parent = stack[-1] if stack else None
        node.close(parent)
        rows.append((CLOSED, node.key, parent.key if parent else None, len(stack), node.least, node.n, node.children, node.leaves, node.saved, node.points, node.ends, node.blocked, *[None] * 5))

    for b in batches:
        for key, depth, least, n, children, leaves, saved, points, ends, blocked, symbol in zip(*[b.column(c).to_pylist() for c in ("key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "points", "ends", "blocked", "symbol")]):
            if not (len(stack) > depth and stack[depth].key == key):
                while len(stack) > depth:
                    pop()
                stack.append(Node(key, symbol, points, True))
            node = stack[depth]
            node.meet(least, n)
            node.children, node.leaves, node.saved = node.children + children, node.leaves + leaves, node.saved + saved
            node.ends, node.blocked = node.ends or ends, node.blocked or blocked
            if len(rows) >= 5_000:
                yield _flush(rows)
    while stack:
        pop()
    if rows:
        yield _flush(rows)


def hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by node and place -> the node's hash. One block is held at a time."""
    now, state = None, None
    done: list[tuple] = []
    for b in batches:
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if state is None or key != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, sha256()
            else:
                state.update(b",")
            numbers = array("q")
            numbers.frombytes(ids)
            state.update(",".join(map(str, numbers)).encode())
    if state is not None:
        done.append((now, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["key", "whole"])


def turn_arrays(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, own: the turns in order as structs of a symbol and a number of code points.

    Null turns come first; turns of one number stand in the order of their symbols. A null role or text is an empty one. Rows without conv_id belong
    to no conversation and are left out."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    symbol = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * SYMBOL)
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").alias("turn"), symbol.alias("symbol"), F.length(text).cast("long").alias("points")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("own"))


def rebuilt(turns: DataFrame, hundred: int = HUNDRED, heads: int = HEADS) -> DataFrame:
    """turn_arrays() where the first h turns of each conversation c are those of conversation c - c % hundred, as far as it has them;
    h = crc32(c) % heads. Conversations whose base is absent lose their first h turns, and may have none left."""
    base = F.col("conv_id") - F.col("conv_id") % hundred
    arrays = turn_arrays(turns).withColumn("base", base)
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, max(heads - 1, 1)))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    none = F.slice("own", 1, 0)
    return arrays.withColumns({"first": F.coalesce(first, none), "h": h}).select("conv_id", F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("own"))


def trie(arrays: DataFrame, block: int = BLOCK) -> DataFrame:
    """arrays(conv_id, own) as of turn_arrays() -> the nodes of their trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns; the root, of depth 0, is that of no turn, and all are its members. Conversations without turns end in
    the root. Equal conversations share all their nodes. No conversation, no node. conv_id must be unique, as it is after turn_arrays(). A task holds one
    conversation's symbols (24 bytes a turn) and the nodes on its path; texts of any length are read once."""
    spark, parts = arrays.sparkSession, shuffle_partitions(arrays.sparkSession)
    strings = arrays.select("conv_id", F.unhex(F.array_join(F.transform("own", lambda x: x["symbol"]), "")).alias("string"), F.transform("own", lambda x: x["points"]).alias("points"))
    dealt = strings.repartitionByRange(parts, "string", "conv_id").sortWithinPartitions("string", "conv_id").withColumn("part", F.spark_partition_id())
    found = materialise(dealt.mapInArrow(partial(sweep, block=block), DDL), "nodes")
    whole = materialise(found.where(F.col("kind") == PARTIAL).repartition(1).sortWithinPartitions("part", "side", "depth").mapInArrow(stitch, DDL), "spines")
    if (top := whole.where("depth = 0").first()) is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    endings = found.where(F.col("kind") == ENDINGS).repartition(parts, "key").sortWithinPartitions("key", "part", "block").mapInArrow(hash_blocks, "key binary, whole string")
    nodes = found.where(F.col("kind") == CLOSED).unionByName(whole)
    ended = nodes.where("NOT blocked").withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).unionByName(nodes.where("blocked").join(endings, "key").withColumnRenamed("whole", "ends_sha256"), allowMissingColumns=True)

    def shown(df: DataFrame, parent: Column) -> DataFrame:
        return df.withColumn("parent_conv_id", parent).select(*[F.col(c).cast("long").alias(c) if c != "ends_sha256" else F.col(c) for c in COLUMNS])

    parents = nodes.where("n_children > 0 AND depth > 0").select(F.col("key").alias("of"), F.col("conv_id").alias("parent_id"))
    deep = ended.where("depth > 1").join(parents, F.col("parent") == F.col("of"))
    return shown(ended.where("depth <= 1"), F.when(F.col("depth") == 1, F.lit(top["conv_id"]))).unionByName(shown(deep, F.col("parent_id")))


def trie_report(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, as the contract has it."""
    return trie(rebuilt(turns))


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII text in DuckDB, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {steps}), lambda a, x: {step}), 4294967295::UBIGINT)"


SQL = f"""
WITH t AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS own FROM (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % {HUNDRED} AS base, CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS BIGINT) AS h FROM t),
r AS (SELECT h.conv_id, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE list_slice(b.own, 1, h) END, list_slice(h.own, h + 1, len(h.own))) AS s FROM h LEFT JOIN t b ON b.conv_id = base),
m AS (SELECT conv_id, s, d, list_slice(s, 1, d) AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(list_last(p)[2]) END AS saved FROM m GROUP BY p, d),
k AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p AND k.d = n.d),
a AS (SELECT list_slice(p, 1, e) AS p, e AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS e FROM w) GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN a ON a.p = w.p AND a.d = w.d LEFT JOIN n u ON u.d = w.d - 1 AND u.p = list_slice(w.p, 1, w.d - 1)
"""
