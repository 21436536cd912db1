"""What the operators of this subpackage share: tables, the shared scratch folder, byte-bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python step holds at once, besides one document that is longer.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and everything runs in one
    process, as in tests, it is a folder of this session's own; on a cluster that is an error."""
    if (at := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='cartulary-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/cartulary-{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage of df with a Parquet table in the shared folder, which outlives any executor."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose texts hold at most so many bytes (or one row, if that is longer)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with text_blocks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, column, most):
            if (out := function(block)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8_size(column: str = "text"):
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def extended(df: DataFrame, **columns: T.DataType) -> T.StructType:
    """The schema of df with more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in columns.items())])
