"""What a session needs for this library: settings, and the library itself on the machines that run its Python."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for large inputs; sizes of partitions are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_SHIPPED: set[str] = set()
_SCRATCH: list[list[str]] = []


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config(map=SETTINGS)


def kept_path(spark: SparkSession, what: str) -> str:
    """A new folder's name below the one that all machines share (``spark.checkpoint.dir``). Where that is unset and everything
    runs in one process, the session gets a folder of its own; on a cluster that is an error."""
    if (at := spark.conf.get("spark.checkpoint.dir", None)) is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='cartulary-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/cartulary-{what}-{uuid.uuid4().hex}"
    for made in _SCRATCH:
        made.append(path)
    return path


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys (unique ones, or nearly) before work that costs much a row: a file of one row group is one task otherwise,
    however many rows it has. A number that is named isn't merged again by Spark, as small tasks of little data but much work would be."""
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(parts, *keys)


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that what reads it several times doesn't compute it again."""
    path = kept_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Drops the tables that are kept within it when it ends: for work whose results are written elsewhere before that."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.remove(made)
        for path in made:
            root = spark._jvm.org.apache.hadoop.fs.Path(path)
            root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once a context, unless they find it by PYTHONPATH or by the folder that
    they start in."""
    root, context = Path(__file__).resolve().parent, spark.sparkContext
    here = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root.parent in here or context.applicationId in _SHIPPED:
        return
    path = Path(tempfile.mkdtemp()) / "cartulary.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
