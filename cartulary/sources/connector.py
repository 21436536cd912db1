"""Document records as a Spark data source: ``register(spark)``, then the format ``records``.

A record is a line of JSON. Files are read in runs of bytes, whichever line a run begins in, so a large file is many partitions. A job that writes
makes files of its own and, at its end, one entry in ``_commits`` that names them with the bounds of their keys: readers see whole jobs
only, filters on the key skip files, and a stream reads the entries one after the other. A job that fails leaves nothing.

Options: ``path``; ``key``, the column whose bounds are kept (``document_id``); ``bytes``, those of a partition; ``entries``, those of a stream's batch.
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

BYTES, ENTRIES = 64 << 20, 100
#: Records of a batch that goes to Spark.
ROWS = 2_000
COMMITS = "_commits"


@dataclass
class Run(InputPartition):
    """The lines of a file that begin in [start, end)."""

    file: str
    start: int
    end: int


@dataclass
class Made(WriterCommitMessage):
    """A file that a task has written; least and most are the bounds of its keys."""

    file: str
    rows: int
    size: int
    least: object
    most: object


class Place:
    """A folder in any store that Arrow reaches by its address."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.store, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def entries(self, after: int = -1) -> list[tuple[int, dict]]:
        """(number, what was committed) of the jobs after one, in order."""
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/{COMMITS}", allow_not_found=True))
        numbers = sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))
        return [(n, json.loads(self.read(f"{COMMITS}/{n:012d}.json"))) for n in numbers if n > after]

    def last(self) -> int:
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/{COMMITS}", allow_not_found=True))
        return max((int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json")), default=-1)

    def read(self, name: str) -> bytes:
        with self.store.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """Under another name first, so that nobody reads half of it."""
        self.store.create_dir(f"{self.root}/{name}".rpartition("/")[0], recursive=True)
        other = f"{self.root}/{name}.{uuid.uuid4().hex}.part"
        with self.store.open_output_stream(other) as f:
            f.write(data)
        self.store.move(other, f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        if self.store.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound:
            self.store.delete_file(f"{self.root}/{name}")

    def commit(self, made: list[Made], overwrite: bool, job: str) -> None:
        """One entry for all files; a job that has been committed already (a batch of a stream that is tried again) adds none."""
        known = self.entries()
        if any(e["job"] == job for _, e in known):
            for m in made:
                self.drop(m.file)
            return
        files = [{"file": m.file, "rows": m.rows, "size": m.size, "least": m.least, "most": m.most} for m in made if m.rows]
        self.write(f"{COMMITS}/{(known[-1][0] if known else -1) + 1:012d}.json", json.dumps({"job": job, "overwrite": overwrite, "files": files}).encode())


def plain(x):
    """A value as JSON has it."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return str(x) if isinstance(x, decimal.Decimal) else x


def typed(x, kind: T.DataType):
    """A JSON value as a column of this type has it; null where it doesn't fit."""
    try:
        if x is None:
            return None
        if isinstance(kind, T.StructType):
            return {f.name: typed(x.get(f.name), f.dataType) for f in kind.fields}
        if isinstance(kind, T.ArrayType):
            return [typed(v, kind.elementType) for v in x]
        if isinstance(kind, T.MapType):
            return [(typed(k, kind.keyType), typed(v, kind.valueType)) for k, v in x.items()]
        if isinstance(kind, T.StringType):
            return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        if isinstance(kind, T.BooleanType):
            return x if isinstance(x, bool) else None
        if isinstance(kind, T.IntegralType):
            return int(x)
        if isinstance(kind, T.FractionalType):
            return decimal.Decimal(str(x)) if isinstance(kind, T.DecimalType) else float(x)
        if isinstance(kind, T.TimestampType):
            t = datetime.datetime.fromisoformat(x)
            return t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(x)
        return bytes.fromhex(x) if isinstance(kind, T.BinaryType) else None
    except (ValueError, TypeError, AttributeError, decimal.InvalidOperation):
        return None


class _Reading:
    """What batches and streams share: runs of files and their lines."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.key, self.schema = options["path"], options.get("key", "document_id"), schema
        self.bytes, self.most = int(options.get("bytes", BYTES)), int(options.get("entries", ENTRIES))

    def runs(self, files: list[dict]) -> list[Run]:
        return [Run(f["file"], at, min(at + self.bytes, f["size"])) for f in files for at in range(0, f["size"], self.bytes)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        place, kinds = Place(self.path), to_arrow_schema(self.schema)
        held: list[list] = []
        with place.store.open_input_file(f"{place.root}/{run.file}") as f:
            for line in lines_of(f, run.start, run.end):
                try:
                    x = json.loads(line)
                except ValueError:
                    x = {}  # a line that is no JSON is a row of nulls
                held.append([typed(x.get(k.name) if isinstance(x, dict) else None, k.dataType) for k in self.schema.fields])
                if len(held) == ROWS:
                    yield self.batch(held, kinds)
                    held = []
        if held:
            yield self.batch(held, kinds)

    @staticmethod
    def batch(rows: list[list], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


def lines_of(f, start: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The lines that begin in [start, end): the first run begins at 0, others behind the first line feed at or after start - 1."""
    place, carry, skip = max(start - 1, 0), b"", start > 0
    f.seek(place)
    while block := f.read(step):
        *whole, carry = (carry + block).split(b"\n")
        for line in whole:
            here, place = place, place + len(line) + 1
            if skip:
                skip = False
            elif here >= end:
                return
            elif line.strip():
                yield line
        if place >= end and not skip:
            return
    if carry.strip() and place < end and not skip:
        yield carry


class Reader(_Reading, DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        super().__init__(options, schema)
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the key skip files; Spark applies all of them to the rows as well."""
        self.tests = [t for t in filters if isinstance(t, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and t.attribute == (self.key,)]
        yield from filters

    def partitions(self) -> list[Run]:
        files: list[dict] = []
        for _, entry in Place(self.path).entries():
            files = ([] if entry["overwrite"] else files) + entry["files"]
        return self.runs([f for f in files if all(self.may_hold(f, t) for t in self.tests)]) or [Run("", 0, 0)]

    @staticmethod
    def may_hold(f: dict, test: Filter) -> bool:
        least, most = f["least"], f["most"]
        if least is None:
            return False  # all keys are null, which no comparison holds for
        try:
            if isinstance(test, In):
                return any(v is not None and least <= plain(v) <= most for v in test.value)
            v = plain(test.value)
            return {EqualTo: lambda: least <= v <= most, GreaterThan: lambda: most > v, GreaterThanOrEqual: lambda: most >= v, LessThan: lambda: least < v, LessThanOrEqual: lambda: least <= v}[type(test)]()
        except TypeError:
            return True

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        return iter(()) if run.end == 0 else super().read(run)


class StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are numbers of entries; an entry that overwrites is read like one that adds."""

    def initialOffset(self) -> dict:
        return {"entry": -1}

    def latestOffset(self) -> dict:
        return {"entry": Place(self.path).last()}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        return self.runs([f for n, e in Place(self.path).entries(start["entry"]) if n <= end["entry"] for f in e["files"]])

    def commit(self, end: dict) -> None:
        pass


class _Writing:
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.key, self.schema, self.overwrite, self.job = options["path"], options.get("key", "document_id"), schema, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Made:
        place, name = Place(self.path), f"{self.job}/part-{uuid.uuid4().hex}.jsonl"
        place.store.create_dir(f"{place.root}/{self.job}", recursive=True)
        n, size, least, most = 0, 0, None, None
        try:
            with place.store.open_output_stream(f"{place.root}/{name}") as f:
                for row in rows:
                    record = {k: plain(v) for k, v in row.asDict().items()}
                    line = json.dumps(record, ensure_ascii=False, allow_nan=False).encode() + b"\n"
                    f.write(line)
                    n, size, key = n + 1, size + len(line), record.get(self.key)
                    if key is not None:
                        least, most = (key, key) if least is None else (min(least, key), max(most, key))
        except BaseException:
            place.drop(name)
            raise
        return Made(name, n, size, least, most)

    def remove(self, messages: list[Made | None]) -> None:
        for m in messages:
            if m is not None:
                Place(self.path).drop(m.file)


class Writer(_Writing, DataSourceWriter):
    def commit(self, messages: list[Made | None]) -> None:
        Place(self.path).commit([m for m in messages if m is not None], self.overwrite, self.job)

    def abort(self, messages: list[Made | None]) -> None:
        """The job's folder goes, with what tasks that were stopped have left in it."""
        place = Place(self.path)
        if place.store.get_file_info(f"{place.root}/{self.job}").type != fs.FileType.NotFound:
            place.store.delete_dir(f"{place.root}/{self.job}")


class StreamWriter(_Writing, DataSourceStreamWriter):
    """A batch is committed once, however often it is tried: its entry is named after the stream and the batch."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        super().__init__(options, schema, overwrite)
        self.stream = options.get("stream", "stream")

    def commit(self, messages: list[Made | None], batchId: int) -> None:
        Place(self.path).commit([m for m in messages if m is not None], False, f"{self.stream}/{batchId}")

    def abort(self, messages: list[Made | None], batchId: int) -> None:
        self.remove(messages)


class Records(DataSource):
    """The format ``records``. A read needs a schema, as records don't carry one; fields that a record lacks, or that don't fit, are null."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        raise ValueError("give the schema of the records")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with the push-down of filters that Spark has off by default for Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
