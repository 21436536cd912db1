"""Operator 13: a Merkle manifest of a dataset, by a stack of peaks per indexed partition.

Leaves are sorted over the cluster by (group, key), and each partition learns at which number of its group it starts. It
then pushes its leaves on a stack, on which each completed run of ``FANOUT`` nodes carries into its parent; what can't be
completed there, as its run began before or ends behind the partition, stays on the stack and is written as a peak. Peaks of a group,
a few a level and partition, go through the same stack once more, which makes the nodes that span partitions. The last run
of a level may be short and is hashed as it is, without padding, since the number of leaves is known.

The subroots of the groups are the leaves of one more tree, made by the same steps. Proofs come from a second walk: a partition makes
its own nodes again and is given those beside its two edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions
from .tries import crc32_sql

#: Nodes of a run.
FANOUT = 3
#: Leaves that a task holds, about; there are as many ranges as that asks for.
TASK_ROWS = 1 << 18
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: bytes) -> bytes:
    """The hash of nodes, as hex text, as it goes into the next one."""
    return sha256(b"".join(parts)).hexdigest().encode()


def widths(total: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


class Peaks:
    """The stack: nodes (level, number, digest) of disjoint runs of leaves, left to right."""

    def __init__(self, total: int) -> None:
        self.widths, self.stack = widths(total), []

    def push(self, level: int, at: int, node: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Adds the node that follows, and yields the parents that it completes."""
        self.stack.append((level, at, node))
        while level + 1 < len(self.widths) and (at % FANOUT == FANOUT - 1 or at == self.widths[level] - 1):
            need = at % FANOUT + 1
            run = self.stack[-need:]
            if len(run) < need or any(x[:2] != (level, at - need + 1 + i) for i, x in enumerate(run)):
                return  # the run began in another partition
            del self.stack[-need:]
            level, at, node = level + 1, at // FANOUT, digest(*[x[2] for x in run])
            self.stack.append((level, at, node))
            yield level, at, node


class Segment:
    """The leaves [start, start + n) of a group, the nodes that they complete, and nodes beside them."""

    def __init__(self, start: int, leaves: list[bytes], total: int, beside: dict[tuple[int, int], bytes]) -> None:
        self.widths, self.beside, self.levels = widths(total), beside, [(start, leaves)]
        for width in self.widths[:-1]:
            low, nodes = self.levels[-1]
            runs = range(-(-low // FANOUT), -(-width // FANOUT) if low + len(nodes) == width else (low + len(nodes)) // FANOUT)
            self.levels.append((runs.start, [digest(*nodes[r * FANOUT - low : (r + 1) * FANOUT - low]) for r in runs]))
        self.known: list[tuple[int, list]] = [(-1, [])] * len(self.widths)

    def node(self, level: int, at: int) -> bytes:
        low, nodes = self.levels[level]
        return nodes[at - low] if low <= at < low + len(nodes) else self.beside[level, at]

    def path(self, at: int, level: int = 0) -> list[tuple[bytes, bytes]]:
        """Siblings left and right of a node and of those above it, up to the group's root. Neighbours share what lies above."""
        if level + 1 == len(self.widths):
            return []
        if self.known[level][0] != at:
            run = at // FANOUT
            ends = min((run + 1) * FANOUT, self.widths[level])
            own = (b"".join(self.node(level, i) for i in range(run * FANOUT, at)), b"".join(self.node(level, i) for i in range(at + 1, ends)))
            self.known[level] = (at, [own, *self.path(run, level + 1)])
        return self.known[level][1]

    @staticmethod
    def wanted(start: int, n: int, total: int) -> Iterator[tuple[int, int]]:
        """The nodes beside: of the runs at both edges, those that the segment doesn't complete."""
        low, high = start, start + n
        first, last = start, start + n - 1
        for level, width in enumerate(widths(total)[:-1]):
            runs = {first // FANOUT, last // FANOUT}
            yield from sorted((level, i) for r in runs for i in range(r * FANOUT, min((r + 1) * FANOUT, width)) if not low <= i < high)
            low, high = -(-low // FANOUT), -(-high // FANOUT) if high == width else high // FANOUT
            high, first, last = max(low, high), first // FANOUT, last // FANOUT


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


@dataclass
class Tree:
    """leaves(part, pos, grp, node, ...) in order; segments(part, grp, pos, n, start, total); nodes(grp, level, at, node, total)
    that are a partition's peaks or span partitions; ``parts`` ranges."""

    leaves: DataFrame
    segments: DataFrame
    nodes: DataFrame
    parts: int

    def tops(self) -> DataFrame:
        return self.nodes.where("top").select("grp", "node")


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


NODES = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("node", pa.binary()), ("total", pa.int64()), ("top", pa.bool_()), ("first", pa.int64())])
NODES_DDL = "grp string, level int, at long, node binary, total long, top boolean, first long"


def grow(leaves: DataFrame, order: list[str]) -> Tree:
    """leaves(grp, node, ...) -> their Tree. Equal rows of ``order`` are interchangeable."""
    spark = leaves.sparkSession
    parts = max(shuffle_partitions(spark), -(-leaves.count() // TASK_ROWS))
    dealt = leaves.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    number = F.monotonically_increasing_id()
    kept = materialise(dealt.withColumns({"part": F.spark_partition_id(), "pos": number.bitwiseAND(F.lit((1 << 33) - 1))}), "leaves")
    each = kept.groupBy("part", "grp").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    earlier = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = materialise(each.withColumns({"start": earlier, "total": F.sum("n").over(group)}), "segments")

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            stack, grp, at, total = None, None, 0, 0
            for name, node, start, whole in _rows(batches, "grp", "node", "start", "total"):
                if node is None:  # the segment's own row, before its leaves
                    yield from of(stack, grp, total)
                    stack, grp, at, total = Peaks(whole), name, start, whole
                    continue
                for _ in stack.push(0, at, node.hex().encode()):
                    pass
                at += 1
            yield from of(stack, grp, total)

        def of(stack: Peaks | None, grp: str | None, total: int) -> Iterator[tuple]:
            for level, at, node in stack.stack if stack else ():
                yield grp, level, at, bytes.fromhex(node.decode()), total, level + 1 == len(stack.widths), at * FANOUT**level

        yield from _batches(found(), NODES)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            stack, now = None, None
            for grp, level, at, node, total, top, first in _rows(batches, *NODES.names):
                if stack is None or now != grp:
                    stack, now = Peaks(total), grp
                yield grp, level, at, node, total, top, first
                for up, i, made in stack.push(level, at, node.hex().encode()):
                    yield grp, up, i, bytes.fromhex(made.decode()), total, up + 1 == len(stack.widths), i * FANOUT**up

        yield from _batches(found(), NODES)

    stream = kept.select("part", "pos", "grp", "node").unionByName(segments.select("part", "pos", "grp", "start", "total"), allowMissingColumns=True)
    stream = stream.repartitionById(parts, "part").sortWithinPartitions("part", "pos", F.col("node").isNotNull())
    found = stream.mapInArrow(peaks, NODES_DDL)
    nodes = found.repartition(shuffle_partitions(spark), "grp").sortWithinPartitions("grp", "first").mapInArrow(merged, NODES_DDL)
    return Tree(kept, segments, materialise(nodes, "nodes"), parts)


def walk(tree: Tree, finish: Callable, schema: pa.Schema, ddl: str, carried: list[str], above: DataFrame | None = None) -> DataFrame:
    """finish(path, carried values, node, subroot) for each leaf, where path goes to the group's root and then, if
    ``above``(grp, path, subroot) is given, on along the group's path there. A task holds its own leaves' digests."""
    if above is not None:
        heads = tree.segments.join(above.withColumnRenamed("grp", "of"), F.col("grp").eqNullSafe(F.col("of")), "left").drop("of")
    else:
        heads = tree.segments.withColumns({"path": F.lit(None).cast(PATH), "subroot": F.lit(None).cast("string")})

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("of", pa.string()), ("l", pa.int32()), ("i", pa.int64())])
        yield from _batches(((part, pos, grp, level, i) for part, grp, pos, n, start, total in _rows(batches, "part", "grp", "pos", "n", "start", "total") for level, i in Segment.wanted(start, n, total)), kind)

    wanted = tree.segments.where("n < total").mapInArrow(edges, "part int, pos long, of string, l int, i long")
    beside = wanted.join(tree.nodes, F.col("grp").eqNullSafe(F.col("of")) & (F.col("l") == F.col("level")) & (F.col("i") == F.col("at"))).select("part", "pos", "grp", "node", "level", "at", F.lit(1).alias("kind"))
    stream = tree.leaves.select("part", "pos", "grp", "node", *carried, F.lit(2).alias("kind"))
    for more in (heads.select("part", "pos", "grp", "start", "total", "path", "subroot", F.lit(0).alias("kind")), beside):
        stream = stream.unionByName(more, allowMissingColumns=True)
    stream = stream.repartitionById(tree.parts, "part").sortWithinPartitions("part", "pos", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            head, beside, leaves, own = None, {}, [], []
            for kind, start, total, path, subroot, level, at, node, *values in _rows(batches, "kind", "start", "total", "path", "subroot", "level", "at", "node", *carried):
                if kind == 0:
                    yield from of(head, beside, leaves, own)
                    head, beside, leaves, own = (start, total, path, subroot), {}, [], []
                elif kind == 1:
                    beside[level, at] = node.hex().encode()
                else:
                    leaves.append(node.hex().encode())
                    own.append(values)
            yield from of(head, beside, leaves, own)

        def of(head: tuple | None, beside: dict, leaves: list[bytes], own: list) -> Iterator[tuple]:
            if head is None:
                return
            start, total, path, subroot = head
            segment, rest = Segment(start, leaves, total, beside), [(x["left"].encode(), x["right"].encode()) for x in path or ()]
            for i, (leaf, values) in enumerate(zip(leaves, own)):
                yield finish([*segment.path(start + i), *rest], values, leaf, subroot)

        yield from _batches(found(), schema, 2_000)

    return stream.mapInArrow(run, ddl)


def field(c: Column) -> Column:
    """A hyphen for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), column: str = "text") -> DataFrame:
    """Per row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified. ``tampered`` is the text that is there
    now, where it isn't the text that was recorded (null: untouched); folding that row's leaf along the recorded siblings shows it.

    Null keys come first in their group and null groups before all others; rows of one key are ordered by their leaves, and
    rows that are equal in all fields are interchangeable. Null fields differ from empty ones. A text of any length counts by its leaf, which is all that is dealt.
    A group of one row has its leaf as subroot, and one group's subroot is the root. Other columns of docs are not read, so their names can't clash. An empty table gives an empty result."""
    now = F.lit(None).cast("string") if tampered is None else tampered
    changed = leaf_of([F.col("__now") if f == column else F.col(f) for f in fields])
    rows = docs.select(*[F.col(f) for f in dict.fromkeys((key, group, *fields))], now.alias("__now"))
    rows = rows.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"), F.unhex(leaf_of([F.col(f) for f in fields])).alias("node"), F.when(F.col("__now").isNotNull(), F.unhex(changed)).alias("changed"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "leaf-rows")  # texts are read once, not once more for the bounds of ranges
    below = grow(rows, ["key", "node", "row"])
    above = grow(below.tops().select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"])
    if (top := above.tops().first()) is None:
        return docs.sparkSession.createDataFrame([], f"{key} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = bytes(top["node"]).hex()

    schema = pa.schema([("grp", pa.string()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string())])
    paths = materialise(walk(above, lambda p, v, leaf, _: (v[0], [{"left": a.decode(), "right": b.decode()} for a, b in p], leaf.decode()), schema, f"grp string, path {PATH}, subroot string", ["name"]), "paths")

    def proved(p: list[tuple[bytes, bytes]], values: list, leaf: bytes, subroot: str) -> tuple:
        folded = fold(values[1].hex().encode() if values[1] is not None else leaf, p).decode()
        return values[0], leaf.decode(), subroot, root, digest(*[x for pair in p for x in pair]).decode(), folded, folded == root

    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema([("key", pa.int64()), *[(n, pa.string()) for n in names], ("verified", pa.bool_())])
    ddl = f"key long, {', '.join(f'{n} string' for n in names)}, verified boolean"
    return walk(below, proved, schema, ddl, ["key", "changed"], paths).withColumnRenamed("key", key)


def manifest_report(docs: DataFrame) -> DataFrame:
    """manifest() where the texts of even crc32(doc_id) have lost their line feeds."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def _field_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# g is the rank of a source, i the number of a node in its level; of the tree over subroots g is -1 and a source's rank is its number.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
                            CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {crc32_sql("CAST(coalesce(doc_id, 0) AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
low AS (SELECT g, 0 AS s, i, n, leaf AS h FROM l
        UNION ALL SELECT g, s + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, s, i // {FANOUT}, n),
sub AS (SELECT g, h FROM low WHERE n = 1),
high AS (SELECT 0 AS s, g AS i, (SELECT count(*) FROM sub) AS n, h FROM sub
         UNION ALL SELECT s + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY s, i // {FANOUT}, n),
own AS (SELECT r, low.s, low.g, low.i, low.n FROM l JOIN (SELECT DISTINCT g, s, n FROM low) w USING (g) JOIN low ON low.g = l.g AND low.s = w.s AND low.i = l.i // CAST({FANOUT}.0 ** w.s AS BIGINT) WHERE low.n > 1),
steps AS (SELECT r, own.s, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i < own.i), '') AS a, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i > own.i), '') AS b
          FROM own JOIN low o ON o.g = own.g AND o.s = own.s AND o.i // {FANOUT} = own.i // {FANOUT} GROUP BY r, own.s
          UNION ALL
          SELECT r, 1000 + x.s, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i < x.i), ''), coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i > x.i), '')
          FROM l JOIN high x ON x.i = l.g // CAST({FANOUT}.0 ** x.s AS BIGINT) JOIN high o ON o.s = x.s AND o.i // {FANOUT} = x.i // {FANOUT} WHERE x.n > 1 GROUP BY r, x.s),
path AS (SELECT r, a, b, row_number() OVER (PARTITION BY r ORDER BY s) AS k FROM steps),
f AS (SELECT r, 0 AS k, coalesce(changed, leaf) AS h FROM l UNION ALL SELECT f.r, f.k + 1, sha256(a || f.h || b) FROM f JOIN path ON path.r = f.r AND path.k = f.k + 1),
folded AS (SELECT r, arg_max(h, k) AS h FROM f GROUP BY r),
proof AS (SELECT r, string_agg(a || b, '' ORDER BY k) AS p FROM path GROUP BY r)
SELECT doc_id, leaf, sub.h AS subroot, high.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded.h AS folded_root, folded.h = high.h AS verified
FROM l JOIN sub USING (g) JOIN high ON high.n = 1 JOIN folded USING (r) LEFT JOIN proof USING (r)
"""
