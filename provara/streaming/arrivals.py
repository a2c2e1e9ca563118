"""Documents as they arrive: operators on single documents run on streams as they are; what is relative to the pool waits for a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provara.operators import redaction, text


def arriving(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of Parquet files of doc_id and text."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def prepared(docs: DataFrame) -> DataFrame:
    """Repaired, redacted and tokenised; works on batches and streams alike."""
    clean = docs.select("doc_id", redaction.redacted(text.repaired(F.col("text"))).alias("r"))
    return clean.select("doc_id", F.col("r.text").alias("text"), F.size("r.spans").alias("n_spans"), text.tokens(F.col("r.text")).alias("tokens"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, ...) by tumbling window and type; rows later than ``late`` go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
