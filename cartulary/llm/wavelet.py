"""Operator 5: token ids in binary files, a wavelet matrix per shard.

A shard is a run of documents in ascending key order; a task writes one or several, so what it holds is bounded by a
shard and the number of tasks by the input. Its file holds the keys and token counts of its documents, and
the ids of all of them as bit planes: plane 0 has the highest bit of each id in order, and each further plane the next
bit, after a stable partition by the bit before. Planes are cut into blocks, compressed one by one, with the number of
ones before each block, so that token access, counting and occurrence lookup open a block a plane and no more.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import BLOCK_BYTES, encoder
from .common import materialise, scratch_path, shuffle_partitions, text_blocks, utf8_size

MAGIC, END_ID = b"CWM1", 2
#: Text bytes a shard, about, and a task at most, about. What a task holds is the ids of a shard.
SHARD_BYTES, TASK_BYTES = 16 << 20, 512 << 20
#: Ids that are parted at once, so that what a step touches stays in a core's cache.
_RUN = 1 << 16
#: Shards whose starts one window sums up.
_GROUP = 4096
#: Bytes of a plane in one compressed block.
BLOCK = 1 << 15
_NO_KEY = np.iinfo(np.int64).min


def build(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The file of a shard: head, directory of documents, index of blocks, blocks."""
    pack, level, planes, ones = zstandard.ZstdCompressor(level=1).compress, ids, [], []
    for b in range(bits - 1, -1, -1):
        bit = (level & level.dtype.type(1 << b)) != 0
        packed = np.packbits(bit)
        sums = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        ones.append(np.concatenate(([0], np.cumsum(sums))))
        packed = packed.tobytes()
        planes.append([pack(packed[i : i + BLOCK]) for i in range(0, len(packed), BLOCK)])
        if b == 8:  # the lower planes need no more than this
            level = level.astype(np.uint8)
        parted, at = np.empty_like(level), [0, len(level) - int(ones[-1][-1])]
        for i in range(0, len(level), _RUN):
            some, here = level[i : i + _RUN], bit[i : i + _RUN]
            for one, places in enumerate((np.flatnonzero(~here), np.flatnonzero(here))):
                some.take(places, out=parted[at[one] : at[one] + len(places)], mode="clip")
                at[one] += len(places)
        level = parted
    directory = pack(keys.astype("<i8").tobytes() + counts.astype("<i8").tobytes())
    index = pack(np.array(ones, "<i8").tobytes() + np.array([[len(x) for x in p] for p in planes], "<i8").tobytes())
    head = MAGIC + struct.pack("<QQIQQ", len(ids), len(keys), bits, len(directory), len(index))
    return b"".join([head, directory, index, *(x for p in planes for x in p)])


class WaveletMatrix:
    """Reads a shard's file. Blocks are opened when they are asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.n, n_docs, self.bits, n_directory, n_index = struct.unpack_from("<QQIQQ", data, 4)
        at, self._open = 4 + struct.calcsize("<QQIQQ"), zstandard.ZstdDecompressor().decompress
        directory = np.frombuffer(self._open(data[at : at + n_directory]), "<i8")
        self.keys, self.counts = directory[:n_docs], directory[n_docs:]
        blocks = -(-self.n // (8 * BLOCK))
        index = np.frombuffer(self._open(data[at + n_directory : at + n_directory + n_index]), "<i8")
        self.ones = index[: self.bits * (blocks + 1)].reshape(self.bits, blocks + 1)
        sizes = index[self.bits * (blocks + 1) :].reshape(self.bits, blocks)
        self._places = at + n_directory + n_index + np.concatenate(([0], np.cumsum(sizes.ravel())))
        self._data, self._blocks, self._known = data, blocks, {}
        self.zeros = self.n - self.ones[:, -1]

    def _block(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self._known:
            k = plane * self._blocks + block
            self._known[plane, block] = np.unpackbits(np.frombuffer(self._open(self._data[self._places[k] : self._places[k + 1]]), np.uint8))
        return self._known[plane, block]

    def rank(self, plane: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, rest = divmod(i, 8 * BLOCK)
        return int(self.ones[plane, block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one, or zero, of a plane."""
        before = self.ones[plane] if bit else np.minimum(np.arange(self._blocks + 1) * 8 * BLOCK, self.n) - self.ones[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        here = np.flatnonzero(self._block(plane, block)[: self.n - block * 8 * BLOCK] == bit)
        return block * 8 * BLOCK + int(here[k - before[block]])

    def access(self, i: int) -> int:
        value = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, i // (8 * BLOCK))[i % (8 * BLOCK)])
            ones = self.rank(plane, i)
            i = int(self.zeros[plane]) + ones if bit else i - ones
            value = value * 2 + bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences among positions [start, end) lie after the last plane."""
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self.rank(plane, start), self.rank(plane, end)
            one = token >> (self.bits - 1 - plane) & 1
            start, end = (int(self.zeros[plane]) + a, int(self.zeros[plane]) + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        i, end = self._range(token, 0, self.n)
        if not 0 <= k < end - i:
            raise IndexError(k)
        i += k
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            i = self.select(plane, one, i - int(self.zeros[plane]) * one)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order: from the last plane up, each stable partition is undone."""
        values = np.zeros(self.n, np.uint8)
        for plane in range(self.bits - 1, -1, -1):
            if self.bits - 1 - plane in (8, 16):  # wider numbers from this plane up
                values = values.astype((np.uint16, np.uint32)[(self.bits - 1 - plane) // 16])
            above, own = np.empty_like(values), values.dtype.type(1 << (self.bits - 1 - plane))
            at = [0, int(self.zeros[plane])]
            for b in range(self._blocks):
                start = b * 8 * BLOCK
                bit = self._block(plane, b)[: self.n - start].view(bool)
                for i in range(0, len(bit), _RUN):
                    here, part = bit[i : i + _RUN], above[start + i : start + i + _RUN]
                    for one, places in enumerate((np.flatnonzero(~here), np.flatnonzero(here))):
                        below = values[at[one] : at[one] + len(places)]
                        part[places] = below | own if one else below
                        at[one] += len(places)
            self._known.clear()
            values = above
        return values.astype(np.uint32)


class Shards:
    """What write_ids() has written: a table (task, part, n) with one row a file, and their number."""

    def __init__(self, path: str, table: DataFrame):
        self.path, self.table, self.count = path, table, table.count()

    def __len__(self) -> int:
        return self.count

    def starts(self) -> DataFrame:
        """(task, part, start): the ids of all files before each. Sums of groups of tasks come to the driver."""
        groups = self.table.withColumn("g", F.floor(F.col("task") / _GROUP))
        sums, before = [], 0
        for r in sorted(groups.groupBy("g").agg(F.sum("n").alias("n")).collect()):
            sums.append((r["g"], before))
            before += r["n"]
        bases = self.table.sparkSession.createDataFrame(sums, "g long, base long")
        order = Window.partitionBy("g").orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
        return groups.withColumn("own", F.coalesce(F.sum("n").over(order), F.lit(0))).join(bases, "g").select("task", "part", (F.col("base") + F.col("own")).alias("start"))


def _name(folder: str, task: int, part: int) -> str:
    return f"{folder}/shard-{task:07d}-{part:05d}.cwm"


def write_ids(docs: DataFrame, vocabulary: str, kind: str = "json", path: str | None = None, end_id: int = END_ID, key: str = "doc_id", column: str = "text", shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> tuple[str, Shards]:
    """Writes the shards below path (a folder that all machines reach), in ascending key order, and returns the path and
    what was written.

    Null and empty texts have the end id alone. Rows that repeat a key follow each other by hash of their text; null
    keys come first. A text of any length is in one shard, and is held whole. Other columns of docs are not read, so
    their names can't clash. A file is written under a name of its own attempt and then renamed, so a task that runs
    twice does no harm. An empty table writes no file."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ids")
    total = docs.agg(F.sum(utf8_size(column) + 1)).first()[0] or 0
    tasks = max(1, -(-total // max(task_bytes, shard_bytes)), min(-(-total // shard_bytes), shuffle_partitions(spark)))
    text = F.coalesce(F.col(column), F.lit(""))
    ordered = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("key"), F.xxhash64(text).alias("t"), text.alias("text"))
    ordered = ordered.repartitionByRange(tasks, "key", "t").sortWithinPartitions("key", "t")

    def run(batches):
        own, task, part = encoder(kind, vocabulary), TaskContext.get().partitionId(), 0
        bits = max(int(own.tokenizer.get_vocab_size() - 1), end_id, 1).bit_length()
        fs, folder = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        keys, counts, ids, held = [], [], [], 0

        def write() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            trial = f"{folder}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(trial) as f:
                f.write(build(all_ids, np.concatenate(keys), np.concatenate(counts), bits))
            fs.move(trial, _name(folder, task, part))
            for x in (keys, counts, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (task, part, len(all_ids))], names=["task", "part", "n"])

        for batch in text_blocks(batches, most=min(BLOCK_BYTES, shard_bytes)):
            keys.append(batch.column(0).to_numpy())
            made, n = own.encode_all(batch.column(2))
            counts.append(n + 1)
            ids.append(np.insert(made.astype(np.uint16 if bits <= 16 else np.uint32), np.cumsum(n), end_id))
            held += pc.sum(pc.binary_length(batch.column(2))).as_py() + batch.num_rows
            # Ranges are only about equal, so a file of half as much again is rather written than a small one after it.
            if 2 * held >= 3 * shard_bytes:
                yield write()
                part, held = part + 1, 0
        if keys:
            yield write()

    return path, Shards(path, materialise(ordered.mapInArrow(run, "task long, part long, n long"), "id-shards"))


def read_ids(spark: SparkSession, path: str, shards: Shards, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, with_ids: ids) of every document, from the files. start counts the ids of all
    documents before; a shard's first one follows from the sizes of the shards before it."""

    def run(batches):
        fs, folder = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for task, part, start in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_stream(_name(folder, task, part)) as f:
                    m = WaveletMatrix(f.read())
                ids = m.tokens().astype("<u4")
                ends = np.cumsum(m.counts)
                begins = ends - m.counts
                for i in range(0, len(ends), 2000):
                    some = slice(i, i + 2000)
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins[some].tolist(), ends[some].tolist())]
                    keys = m.keys[some]
                    made = [pa.array(keys, mask=keys == _NO_KEY), pa.array(start + begins[some]), pa.array(m.counts[some]), pa.array(sums, pa.int64())]
                    if with_ids:
                        made.append(pa.ListArray.from_arrays(pa.array(np.append(begins[some], ends[some][-1]) - begins[i], pa.int32()), pa.array(ids[begins[i] : ends[some][-1]].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(made, names=[key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not len(shards):
        return spark.createDataFrame([], schema)
    # Only places travel, a few files a task; the task opens them.
    return shards.starts().repartition(min(len(shards), 4 * shuffle_partitions(spark)), "task", "part").mapInArrow(run, schema)


def id_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the ids of docs and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return read_ids(docs.sparkSession, *write_ids(docs, vocabulary), with_ids=False)
