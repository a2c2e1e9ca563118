"""Quality classifier: ordinal regression on graded ratings (see ordinal.py).

Words keep their marks and capitals, and starts and ends of words are features
too, since junk shows in the shape of words. A document is kept if the
probability of ``least`` or a better grade reaches ``cut``.

Repeated rows get equal results, an empty table no rows; nulls, ties and very long
texts are as in ordinal.py. Columns of the results' names are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provara.llm import ordinal

FEATURES = ordinal.Features(letters=False, head=3, tail=3)


def fit_quality(docs: DataFrame, ratings: DataFrame, max_rows: int = 6000, max_bytes: int = 64 << 20) -> ordinal.OrdinalModel:
    """ratings: doc_id and grade (int, any number of grades, higher is better)."""
    return ordinal.fit(docs, ratings, FEATURES, max_rows, max_bytes)


def score_quality(docs: DataFrame, model: ordinal.OrdinalModel, least: int = 1, cut: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_prob and keep; one row for each row, in which columns of these names are replaced. A null or empty text is no evidence of quality: keep is false."""
    # columns of docs travel as one struct, so that only those of the results' names are replaced
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("expected_grade", "tail_prob", "keep")))
    told = docs.select(rest.alias("row"), F.length(F.coalesce("text", F.lit(""))).alias("n"), ordinal.graded(model, F.col("text"), least).alias("g"))
    chosen = (F.col("n") > 0) & (F.col("g.tail") >= cut)
    return told.select("row.*", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("tail_prob"), chosen.alias("keep"))
