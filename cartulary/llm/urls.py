"""Operator 11: URL filters by a sort-merge range join.

A host read from its last label to its first, each label followed by a slash (``net/example/blog/``), is a key under which
a domain and all that lies below it are one interval: the keys that begin with the domain's. Rules and URLs are dealt
by ranges of these keys, a rule to each range that its interval touches, and sorted. One sweep a task then keeps a stack of the
rules whose intervals are open; as intervals of prefixes are nested or apart, the stack holds just the rules of the
hosts above the current one. Paths are prefixes too, and are looked up in the open rules by their lengths.

A task holds the rules of one chain of nested hosts, never the list; hot hosts and hot URLs are cut by path and by row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, shuffle_partitions

#: Keys that are sampled for each range; they decide how evenly ranges are filled, never what is found.
SAMPLE_A_RANGE = 64
#: Characters of a sampled key and path.
SAMPLE_CHARS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, a question mark, a number sign or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, a number sign or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


class Sweep:
    """The open rules at a place of the sorted keys: a frame for each host that has rules, outermost first."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        self.last: tuple[str, str] | None = None
        self.answer: tuple[str | None, str | None] = (None, None)

    def close(self, key: str) -> None:
        while self.frames and not key.startswith(self.frames[-1][0]):
            self.frames.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        self.last = None
        if not self.frames or self.frames[-1][0] != key:
            self.frames.append((key, {}, []))
        _, paths, lengths = self.frames[-1]
        paths[path] = (rule, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest open rule that fits; of equally long ones, that with the longer host."""
        if self.last == (key, path):
            return self.answer
        self.close(key)
        best: tuple[int, str | None, str | None] = (-1, None, None)
        for _, paths, lengths in reversed(self.frames):
            fits = next((paths[path[:n]] for n in lengths if n <= len(path) and path[:n] in paths), None)
            if fits and len(fits[0]) > best[0]:
                best = (len(fits[0]), *fits)
        self.last, self.answer = (key, path), best[1:]
        return self.answer


def split_points(keys: DataFrame, parts: int) -> list[tuple]:
    """Rows (key, path, row) of a sample of bounded size that cut it into so many runs."""
    rows = keys.count()
    some = keys.sample(min(1.0, SAMPLE_A_RANGE * parts / max(rows, 1)), seed=11)
    cut = sorted(tuple(r) for r in some.select(F.substring("key", 1, SAMPLE_CHARS), F.substring("path", 1, SAMPLE_CHARS), "row").collect())
    return sorted({cut[i * len(cut) // parts] for i in range(1, parts)}) if cut else []


def filter_urls(pages: DataFrame, rules: DataFrame, column: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict, which replace columns of these names. rules: host, path, verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest (host and path
    together) wins, of equally long ones that with the longer host, and of repeated rules the greatest verdict (block
    before allow). Where none fits, ``rule`` is null and the verdict is ``default``. Rules without a host fit nothing, a null path is an empty one.
    Null URLs and those without ``://`` have an empty host and path. Ports and names of users belong to the host, so a rule
    doesn't fit a host with a port. Repeated rows stay; an empty table gives an empty result, no rules give the default. All columns are dealt
    with their rows: select the narrow ones first."""
    spark, parts = pages.sparkSession, shuffle_partitions(pages.sparkSession)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own") if kept else F.struct(F.lit(0).alias("_")).alias("own"), host_of(F.col(column)).alias("host"), path_of(F.col(column)).alias("path"))
    urls = urls.select("own", "host", "path", host_key(F.col("host")).alias("key"), F.monotonically_increasing_id().alias("row"))
    bounds = split_points(urls.select("key", "path", "row"), parts)
    once = rules.where("host IS NOT NULL").groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    once = once.select("host", "path", host_key(F.col("host")).alias("key"), F.lit(-1).cast("long").alias("row"), F.concat("host", "path").alias("rule"), "verdict")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, t) for t in zip(b.column("key").to_pylist(), b.column("path").to_pylist(), b.column("row").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "part"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule goes to each range between the first and the last key of its interval."""
        for b in batches:
            where = [(i, p) for i, k in enumerate(b.column("key").to_pylist()) for p in range(bisect_right(bounds, (k, "", -1)), bisect_right(bounds, (f"{k[:-1]}0", "", -1)) + 1)]
            for start in range(0, len(where), 10_000):
                some = where[start : start + 10_000]
                taken = b.take(pa.array([i for i, _ in some], pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([p for _, p in some], pa.int32())], [*b.schema.names, "part"])

    dealt = urls.mapInArrow(place, extended(urls, part=T.IntegerType())).unionByName(once.mapInArrow(spread, extended(once, part=T.IntegerType())), allowMissingColumns=True)
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "key", F.col("row") >= 0, "path", "row")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rules = Sweep()
        for b in batches:
            rule, verdict, mine = [], [], []
            for i, (key, path, row, name, says) in enumerate(zip(*[b.column(c).to_pylist() for c in ("key", "path", "row", "rule", "verdict")])):
                if row < 0:
                    open_rules.open(key, path, name, says)
                else:
                    fits = open_rules.judge(key, path)
                    mine.append(i)
                    rule.append(fits[0])
                    verdict.append(default if fits[0] is None else fits[1])
            if mine:
                own = b.select(["own", "host", "path"]).take(pa.array(mine, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["own", "host", "path", "rule", "verdict"])

    schema = T.StructType([*urls.schema.fields[:3], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return dealt.mapInArrow(sweep, schema).select(*[F.col("own").getField(c).alias(c) for c in kept], "host", "path", "rule", "verdict")


def url_report(pages: DataFrame) -> DataFrame:
    """filter_urls() under the contract's rules."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH u AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
fits AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN fits USING (r)
"""
