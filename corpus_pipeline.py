"""From raw documents to packed training bins, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; run()
writes each result as Parquet to the shared folder and reads it again for the
next; what a stage wrote for itself goes when its result is written.

In every stage a null text counts as empty, a null doc_id or source is a value of
its own, repeated rows count one by one, texts are read whole, other columns may
have any name and stay, and an empty table gives no rows. What each does with empty
texts, repeated rows and ties:

- quality: empty texts go; repeated rows stay or go together; a probability at the
  cut stays.
- exact_dedup: of rows equal but for white space the longest, then least doc_id
  stays; of repeated rows one.
- near_dedup: the row of least doc_id, then row key, of each class stays; of
  repeated rows one. Empty texts are one class.
- mixing: empty texts have no words and are taken as often as every row of their source is at
  least; of repeated rows some are taken once more than others.
- packing: pieces of equal size are placed by doc_id, then hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provara.llm import exactdedup, mixing, neardedup, packing, quality, shared
from provara.session import ship, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    # columns of docs travel as one struct, so that none is replaced by the classifier's
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return quality.score_quality(rows, quality.fit_quality(docs, ratings)).where("keep").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    ship(spark)
    return exactdedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    ship(spark)
    return neardedup.near_deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, first_word, n_words and bin_id of every piece."""
    ship(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, BagMinHash and pivotal rounding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with shared.Scratch(spark) as tables:
            docs = tables.keep(stage(spark, docs, sf_dir))
    return docs
