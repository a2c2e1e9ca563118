"""Tables in the folder that driver and executors share, row keys, checked broadcasts and joins on hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most so many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a join leaves in one part, and keys that are dealt over several at most. Any
#: further key has at most 1 / HOT_KEYS of all rows, since the keys of most rows are taken.
SALT_ROWS, HOT_KEYS = 2000, 10_000

#: What the contracts count as white space.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Columns of a row's 128-bit key.
KEY = ("key", "key2")

#: The Scratches open in this thread, innermost last: calls in other threads do not see them.
_open: ContextVar[tuple[Scratch, ...]] = ContextVar("open", default=())


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, one of our own on a local master only."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="provara-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write(df: DataFrame, owner: Scratch | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/provara-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if owner:
        owner.paths.append(path)
    else:
        fs, p = _file_system(spark, path)
        fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing of it.

    The table goes with the innermost Scratch that is open, else when the application ends.
    """
    return _write(df, _open.get()[-1] if _open.get() else None)


class Scratch:
    """Within it, written() makes tables that go when it is left, but for those that keep() makes for the caller."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.token = _open.set((*_open.get(), self))
        return self

    def __exit__(self, *_: object) -> None:
        _open.reset(self.token)
        for path in self.paths:
            fs, p = _file_system(self.spark, path)
            fs.delete(p, True)

    def keep(self, df: DataFrame) -> DataFrame:
        outer = _open.get()[: _open.get().index(self)]
        return _write(df, outer[-1] if outer else None)


def with_checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() write to the shared folder where the application names no folder of its own."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder(spark))


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a written table is small enough to broadcast."""
    return df.count() <= limit


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, broadcast if it is small; beyond that the join shuffles."""
    return F.broadcast(df) if few(df, limit) else df


def dealt(
    left: DataFrame, right: DataFrame, keys: Sequence[str], counted: DataFrame, how: str = "inner", by: Column | None = None
) -> DataFrame:
    """left joined to right on keys, with hot keys dealt over several tasks.

    counted has the keys and n, the number of rows of left for each. The HOT_KEYS keys of most rows (if over
    SALT_ROWS) get parts of SALT_ROWS rows each: rows of left go to a part by the value of ``by``, or without
    one by their place in left, which then is a written table or one of files; rows of right go to all parts
    of their key.
    """
    hot = counted.where(F.col("n") > SALT_ROWS)
    if not hot.limit(1).count():
        return left.join(right, list(keys), how)
    hot = hot.orderBy(F.desc("n"), *keys).limit(HOT_KEYS)
    # at most HOT_KEYS rows, which any caller may still read
    parts = _write(hot.select(*keys, F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("provara_parts")).coalesce(1), None)
    number = F.coalesce("provara_parts", F.lit(1))
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()) if by is None else by, number).cast("int")
    left = left.join(F.broadcast(parts), list(keys), "left").withColumn("provara_part", deal).drop("provara_parts")
    every = F.explode(F.sequence(F.lit(0), number - 1))
    right = right.join(F.broadcast(parts), list(keys), "left").withColumn("provara_part", every).drop("provara_parts")
    return left.join(right, [*keys, "provara_part"], how).drop("provara_part")


def repeated(df: DataFrame, n: str, name: str = "repeat") -> DataFrame:
    """Each row n times, with a number from 0 on; in two steps, so that no array grows with n itself."""
    run = 10_000
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / run)))
    df = df.where(F.col(n) > 0).withColumn("provara_run", runs)
    last = F.least(F.col("provara_run") * run + run, F.col(n)) - 1
    return df.withColumn(name, F.explode(F.sequence(F.col("provara_run") * run, last))).drop("provara_run")


def body() -> Column:
    """The text of a row, null as empty."""
    return F.coalesce("text", F.lit(""))


def text_key() -> list[Column]:
    """key and key2: 128 bits of the text."""
    return [F.xxhash64(body()).alias("key"), F.xxhash64(F.lit("second"), body()).alias("key2")]


def row_key() -> list[Column]:
    """key and key2: 128 bits of doc_id and text. A null doc_id is unlike any other; repeated rows are alike."""
    null = F.isnull("doc_id")
    first = F.xxhash64(null, "doc_id", body())
    return [first.alias("key"), F.xxhash64(F.lit("second"), body(), null, "doc_id").alias("key2")]


def n_inputs(df: DataFrame) -> int:
    """Partitions that a plan starts from."""
    return max(1, df.rdd.getNumPartitions())


def only_kept(docs: DataFrame, told: DataFrame) -> DataFrame:
    """docs without the rows told (key, key2, kept; a written table) to go; of repeated rows of which one stays, one does.

    Columns of docs travel as one struct, so none of their names can clash.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_key())
    keys = told.groupBy(*KEY).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    changed = written(keys.where("not stays or n > 1"))
    if few(changed):
        alone = rows.join(F.broadcast(changed), list(KEY), "left_anti")
        again = rows.join(F.broadcast(changed.where("stays").select(*KEY)), list(KEY), "left_semi")
    else:
        both = dealt(rows, keys, KEY, keys.where(F.col("n") > SALT_ROWS))
        alone, again = both.where("stays and n = 1"), both.where("stays and n > 1")
    again = again.groupBy(*KEY).agg(F.first("row").alias("row"))
    return alone.select("row.*").unionByName(again.select("row.*"))
