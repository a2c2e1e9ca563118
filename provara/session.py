"""The package on every executor, and tables of a data folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch: with long texts a batch of the default number of rows would not be bounded by a task's share of memory.
ARROW_BYTES = 8 << 20
#: Characters of text of a task that holds all its distinct terms or pairs of them.
TASK_CHARS = 12_000_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once per application, so that Arrow functions can be unpickled there, and bounds the session's Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "provara.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of files dealt over all cores where the files make fewer tasks than there are cores. Larger inputs are read as they are: nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded(df: DataFrame, column: str, most: int = TASK_CHARS) -> DataFrame:
    """Rows dealt so that a task has about ``most`` characters of the column, however large the files' parts are; at least as spread() deals them."""
    chars = df.agg(F.sum(F.length(column)).alias("n")).first().n or 0
    tasks = -(-chars // most)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else spread(df)


def settled(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that spark.checkpoint.dir names, so that all who read them see the same partitions; it goes when the application ends."""
    spark = df.sparkSession
    if not (top := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="provara-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/provara-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
