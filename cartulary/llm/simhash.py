"""Operator 1: SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at three or fewer differing bits. Every fingerprint emits all variants within half that
radius: one bit, rounded down, for fingerprints of odd weight, two bits, rounded up, for those of even weight. Two
fingerprints at odd distance have weights of different parity, so the two balls always meet; at distance two both
emit the variant in the middle.

Each variant has an owner among the fingerprints within one bit of it. Whoever else emits the variant is within two
bits of it, so within three of the owner: a variant gives the links owner-member and no other pairs, and a group of any
size one link a member. The distance of every link is verified on both fingerprints.

Variants aren't shuffled one by one. Some bits of the fingerprint, as many as the number of fingerprints asks for, choose
the task: only the variants that differ in those bits are emitted before the shuffle (56 rows at most for 10 bits, 211
for 20), and each task makes the rest of its balls itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, shuffle_partitions
from .components import connected_components

RADIUS, WIDTH = 3, 3
#: Bits that choose the task, from least to most.
ROUTES = range(10, 25)
#: Fingerprint rows that a task of the join gets, about: each makes up to 1,431 variants.
TASK_ROWS = 60_000
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)
#: Shingles counted at once.
_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 (seed 42). No words: zero."""
    words = (text or "").encode(errors="surrogatepass").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(data, 42)
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1)).tolist()
    ends = np.append(spaces, len(data)).tolist()[width - 1 :]
    n, counts, digest = len(ends), np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, _AT_ONCE):
        hashed = b"".join([digest(data[a:b], 42) for a, b in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE])])
        lanes = np.frombuffer(hashed, np.uint8).reshape(-1, 8) + _LANES
        counts += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = WIDTH, *carry: str) -> DataFrame:
    """(key, fp, and the long columns to carry): fp is the fingerprint as a signed long."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, width) for x in block.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([block.column(0), pa.array(found), *block.columns[2:]], names=[key, "fp", *carry])

    return map_texts(docs.select(F.col(key).cast("long").alias(key), column, *carry), run, ", ".join(f"{c} long" for c in (key, "fp", *carry)), column)


def ball_links(nodes: DataFrame) -> DataFrame:
    """nodes(fp, node), fp distinct -> links (a, b) of nodes within RADIUS bits that connect whatever is within it."""
    spark, n = nodes.sparkSession, nodes.count()
    # Half of the fingerprints are sent 1 + r times and half 1 + r + r * (r - 1) / 2 times, to 2 ** r routes.
    sent_rows = {r: n * (1 + r + r * (r - 1) // 4) for r in ROUTES}
    route = next((r for r in ROUTES if sent_rows[r] >> r <= TASK_ROWS), ROUTES[-1])
    parts = max(shuffle_partitions(spark), sent_rows[route] // TASK_ROWS)
    flips = [(0, 0)] + [(1 << i, 1) for i in range(route)] + [((1 << i) | (1 << j), 2) for i in range(route) for j in range(i)]
    table = F.array(*[F.struct(F.lit(f).cast("long").alias("flip"), F.lit(d).cast("int").alias("used")) for f, d in flips])
    odd = F.bit_count("fp") % 2 == 1
    sent = (
        nodes.select("fp", "node", F.explode(F.when(odd, F.slice(table, 1, route + 1)).otherwise(table)).alias("r"))
        .select(F.col("fp").bitwiseXOR(F.col("r.flip")).alias("base"), "node", F.col("r.used").alias("used"), "fp")
        .repartition(parts, F.col("base").bitwiseAND(F.lit((1 << route) - 1).cast("long")))
    )
    return sent.mapInArrow(lambda b: _meet(b, route), "a long, b long").distinct()


def _meet(batches, route: int):
    """All rows of a task: whole routes, so whatever meets at a variant meets here."""
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()) for b in batches]
    if not rows:
        return
    base, node, used, fp = (np.concatenate([r[k] for r in rows]) for k in range(4))
    base, fp = base.view(np.uint64), fp.view(np.uint64)
    odd = np.bitwise_count(fp) % 2 == 1
    rest = np.uint64(1) << np.arange(route, 64, dtype=np.uint64)
    near, fresh = np.flatnonzero(used <= 1), np.flatnonzero(used == 0)
    inner = np.concatenate([base[near], (base[fresh, None] ^ rest).ravel()])
    owner = np.concatenate([near, np.repeat(fresh, len(rest))])  # as rows
    order = np.lexsort((node[owner], inner))
    inner, owner = inner[order], owner[order]
    first = np.concatenate(([True], inner[1:] != inner[:-1])) if len(inner) else np.zeros(0, bool)
    heads, head_owner = inner[first], owner[first]

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distinct links of rows, verified."""
        true = (node[a] != node[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS)
        return np.unique(np.stack([node[a[true]], node[b[true]]], axis=1), axis=0)

    links = linked(owner, np.repeat(head_owner, np.diff(np.append(np.flatnonzero(first), len(inner)))))
    bits = np.uint64(min(25, max(12, int(16 * max(len(heads), 1)).bit_length())))
    spot = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - bits)
    taken = np.zeros(1 << int(bits), bool)
    taken[spot(heads)] = True

    def outer(values: np.ndarray, members: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(taken[spot(values)])
        if not len(maybe) or not len(heads):
            return np.zeros((0, 2), np.int64)
        values, members = values[maybe], members[maybe]
        at = np.minimum(np.searchsorted(heads, values), len(heads) - 1)
        met = heads[at] == values
        return linked(members[met], head_owner[at[met]])

    twice = np.flatnonzero(used == 2)
    found, most = [links, outer(base[twice], twice)], 1 << 20
    pairs = np.array([rest[i] | rest[j] for i in range(len(rest)) for j in range(i)], np.uint64)
    for use, flips, chunk in ((1, rest, 4096), (0, pairs, 256)):
        own = np.flatnonzero((used == use) & ~odd)
        for at in range(0, len(own), chunk):
            some = own[at : at + chunk]
            found.append(outer((base[some, None] ^ flips).ravel(), np.repeat(some, len(flips))))
            if sum(map(len, found)) > most:
                found = [np.unique(np.concatenate(found), axis=0)]
                most = max(most, 2 * len(found[0]))
    out = np.unique(np.concatenate(found), axis=0)
    for at in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(out[at : at + 50_000, k]) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row of docs: key, fingerprint (16 lowercase hex digits), component_id (smallest key reachable by links).

    Null, empty and blank texts have fingerprint zero and link like any other. Equal fingerprints are one node, so
    copies cost nothing in the join and repeated rows stay. Long texts are hashed in runs of shingles. Other columns of
    docs are not read. Rows with a null key link nothing: they get the component of an equal fingerprint, or null. An
    empty table gives an empty result."""
    own = materialise(fingerprints(docs, key, column, width), "fingerprints")
    nodes = materialise(own.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("node")), "nodes")
    components = connected_components(ball_links(nodes))
    named = nodes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(named, "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = WIDTH, null_keys: bool = False) -> DataFrame:
    """The row of docs whose (key, hash of text) is the smallest of its near-duplicate group. Groups are of fingerprints,
    so different texts under one key are judged apart; of rows that repeat key and text one stays. Rows with a null key
    go, or, with null_keys, are judged like any other and come after all keys, so that a text which no keyed document is
    near to stays. Null, empty and blank texts are one group. Columns of docs stay as they are; an empty table gives an
    empty result."""
    own = docs.withColumn("__text", F.xxhash64(column))
    own = own if null_keys else own.where(F.col(key).isNotNull())
    found = materialise(fingerprints(own, key, column, width, "__text"), "fingerprints")
    nodes = materialise(found.select("fp", F.col("fp").alias("node")).distinct(), "nodes")
    groups = connected_components(ball_links(nodes)).withColumnRenamed("node", "fp")
    group = F.coalesce("component", "fp").alias("group")
    least = F.min(F.struct(F.col(key).isNull().alias("__no_key"), F.coalesce(key, F.lit(0)).alias("__key"), "__text")).alias("first")
    kept = found.join(groups, "fp", "left").groupBy(group).agg(least).select("first.*").distinct()
    own = own.withColumn("__no_key", F.col(key).isNull()).withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(0)))
    by = ["__no_key", "__key", "__text"]
    return own.join(kept, by, "left_semi").dropDuplicates(by).select(*docs.columns)
