"""Toxicity: ordinal regression of severity grades on sparse text features (see ordinal.py).

Features are runs of small letters, so marks and capitals around a word do not
hide it, with starts and ends of words. A document is toxic if the probability
of grade ``least`` or above reaches ``cut``.

Repeated rows get equal results, an empty table no rows; nulls, ties and very long
texts are as in ordinal.py. Columns of the results' names are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provara.llm import ordinal

FEATURES = ordinal.Features(letters=True, head=4, tail=4)


def fit_toxicity(docs: DataFrame, severities: DataFrame, max_rows: int = 10000, max_bytes: int = 256 << 20) -> ordinal.OrdinalModel:
    """severities: doc_id and grade (int, any number of grades, 0 is clean)."""
    return ordinal.fit(docs, severities, FEATURES, max_rows, max_bytes)


def score_toxicity(docs: DataFrame, model: ordinal.OrdinalModel, least: int = 1, cut: float = 0.4) -> DataFrame:
    """docs with expected_severity, tail_prob and toxic; one row for each row, in which columns of these names are replaced. Null and empty texts are not toxic."""
    # columns of docs travel as one struct, so that only those of the results' names are replaced
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("expected_severity", "tail_prob", "toxic")))
    told = docs.select(rest.alias("row"), F.length(F.coalesce("text", F.lit(""))).alias("n"), ordinal.graded(model, F.col("text"), least).alias("g"))
    chosen = (F.col("n") > 0) & (F.col("g.tail") >= cut)
    return told.select("row.*", F.col("g.expected").alias("expected_severity"), F.col("g.tail").alias("tail_prob"), chosen.alias("toxic"))
