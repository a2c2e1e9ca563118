"""Ordinal cumulative-link regression on hashed text features.

P(grade <= k) = sigmoid(threshold[k] - x . w): one weight vector w is shared by
all thresholds, which stay in order because each is the one before plus a
positive step. With two grades this is logistic regression.

A feature is a hashed word, word start or word end; its value is
log(1 + occurrences) / words ** 0.25 over the whole text. Fitting takes at most
``max_rows`` rated rows (those with the least hash of doc_id), and of these the
first whose features together have at most ``max_bytes``, since they go to the
driver; scoring reads every row. L1 shrinkage leaves few weights, so models are small.

Null and empty texts have no feature: they get the thresholds' own
probabilities. Null grades and doc_ids are left out of fitting; repeated rows and
ratings each count. With no rated row at all, or one grade only, the model gives
every text that grade (or grade 0). Rows of one hash of doc_id are taken by doc_id,
then grade. A text is never cut: a task needs some forty times the bytes of its
longest text. Of docs fitting reads doc_id and text only. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provara.llm import shared
from provara.llm.arrowtext import Slice, slices

BITS = 18
#: Entries of the training rows worked on at once, which bounds what fitting holds beside them.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Features:
    """letters: words are runs of small letters, without marks and digits; head, tail: bytes of the start and end features."""

    letters: bool
    head: int
    tail: int

    def slices(self, texts: pa.Array) -> Iterator[Slice]:
        return slices(texts, letters=self.letters)

    def of(self, s: Slice, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value; only the wanted features, where they are given."""
        rows = s.row_of_word
        kinds = [s.rolled_hashes(), s.piece_hashes(head=self.head), s.piece_hashes(tail=self.tail)]
        parts = []
        for i, hashes in enumerate(kinds):
            feature = ((hashes + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int64)
            keep = slice(None) if wanted is None else wanted[feature]
            parts.append(rows[keep] << BITS | feature[keep])
        found, times = np.unique(np.concatenate(parts), return_counts=True)
        row = found >> BITS
        return row, found & ((1 << BITS) - 1), np.log1p(times) / np.sqrt(np.sqrt(np.maximum(s.n_words, 1)[row]))


@dataclass(frozen=True)
class OrdinalModel:
    features: Features
    grades: tuple[int, ...]
    thresholds: tuple[float, ...]
    index: tuple[int, ...] = field(repr=False, default=())
    weight: tuple[float, ...] = field(repr=False, default=())

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each k but the last."""
        return 1 / (1 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -30, 30)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        weights, wanted = _dense(self)
        out = [np.zeros(0)]
        for s in self.features.slices(texts):
            row, feature, value = self.features.of(s, wanted)
            out.append(np.bincount(row, weights[feature] * value, minlength=len(s.rows)))
        return np.concatenate(out)

    def graded(self, texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of a grade of ``least`` or more."""
        scores, grades = self.scores(texts), np.array(self.grades, float)
        above = 1 - self.at_most(scores)
        expected = grades[0] + above @ np.diff(grades) if len(grades) > 1 else np.full(len(scores), grades[0])
        k = int(np.searchsorted(grades, least))
        tail = np.ones(len(scores)) if k == 0 else np.zeros(len(scores)) if k == len(grades) else above[:, k - 1]
        return expected, tail


@lru_cache(4)
def _dense(model: OrdinalModel) -> tuple[np.ndarray, np.ndarray]:
    weights = np.zeros(1 << BITS)
    weights[list(model.index)] = model.weight
    return weights, weights != 0


def fit(
    docs: DataFrame, ratings: DataFrame, features: Features, max_rows: int = 6000, max_bytes: int = 64 << 20,
    l1: float = 3e-4, rounds: int = 150,
) -> OrdinalModel:
    """ratings: doc_id and grade."""
    rated = ratings.select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int").alias("grade"))
    rated = rated.where("rated_id is not null and grade is not null")
    rated = rated.orderBy(F.xxhash64("rated_id"), "rated_id", "grade").limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in features.slices(b.column("text")):
                n = len(s.rows)
                row, feature, value = features.of(s)
                cut = np.searchsorted(row, np.arange(n + 1))
                runs = list(zip(cut, cut[1:], strict=False))
                held = [
                    pa.array([x[a:z].astype(t).tobytes() for a, z in runs], pa.binary())
                    for x, t in ((feature, np.int32), (value, np.float32))
                ]
                own = [b.column(c).slice(s.rows.start, n) for c in ("doc_id", "grade")]
                yield pa.RecordBatch.from_arrays([*own, *held], ["doc_id", "grade", "feature", "value"])

    joined = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("rated_id"))
    made = joined.select("doc_id", "text", "grade").mapInArrow(extract, "doc_id long, grade int, feature binary, value binary")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("grade"), F.col("feature")]
    with shared.Scratch(docs.sparkSession):
        taken = shared.written(made.orderBy(*order).limit(max_rows))
        # at most max_rows rows are in this window
        size = F.sum(F.octet_length("feature") + F.octet_length("value")).over(Window.orderBy(*order))
        rows = taken.withColumn("size", size).where(F.col("size") <= max_bytes).drop("size").collect()
    rows.sort(key=lambda r: (r.doc_id, r.grade, bytes(r.feature)))
    ranked = sorted({r.grade for r in rows})
    if len(ranked) < 2:
        return OrdinalModel(features, tuple(ranked) or (0,), ())
    rank = np.searchsorted(ranked, [r.grade for r in rows])
    lengths = [len(r.feature) // 4 for r in rows]
    feature, value = np.frombuffer(b"".join(r.feature for r in rows), np.int32), np.frombuffer(b"".join(r.value for r in rows), np.float32)
    del rows
    row = np.repeat(np.arange(len(rank), dtype=np.int32), lengths)
    thresholds, weights = solve(row, feature, value, rank, len(ranked), l1, rounds)
    index = np.flatnonzero(weights)
    return OrdinalModel(features, tuple(ranked), tuple(map(float, thresholds)), tuple(map(int, index)), tuple(map(float, weights[index])))


def summed(at: np.ndarray, of: Callable[[slice], np.ndarray] | None, size: int) -> np.ndarray:
    """Sums by place of what ``of`` gives for a run of entries (counts without it), CHUNK entries at a time."""
    out = np.zeros(size)
    for a in range(0, len(at), CHUNK):
        c = slice(a, a + CHUNK)
        out += np.bincount(at[c], of(c) if of else None, minlength=size)
    return out


def solve(row: np.ndarray, feature: np.ndarray, value: np.ndarray, rank: np.ndarray, n_grades: int, l1: float, rounds: int, rare: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and weights by proximal AdaGrad on the mean negative log-likelihood plus l1 * |w|. Features in under ``rare`` rows are left out."""
    n, size = len(rank), 1 << BITS
    common = summed(feature, None, size) >= rare
    kept = np.flatnonzero(common)
    place = np.cumsum(common, dtype=np.int32) - 1
    keep = common[feature]
    row, value, inverse = row[keep], value[keep], place[feature[keep]]
    weights, speed = np.zeros(len(kept)), np.full(len(kept), 1e-8)
    share = np.clip(np.cumsum(np.bincount(rank, minlength=n_grades))[:-1] / n, 1e-6, 1 - 1e-6)
    at = np.log(share / (1 - share))
    base = np.concatenate([at[:1], np.log(np.maximum(np.diff(at), 1e-3))])  # first threshold, log steps
    base_speed = np.full(n_grades - 1, 1e-8)
    low, high = rank > 0, rank < n_grades - 1
    for _ in range(rounds):
        thresholds = np.cumsum(np.concatenate([base[:1], np.exp(base[1:])]))
        z = summed(row, lambda c: weights[inverse[c]] * value[c], n)
        upper = np.where(high, 1 / (1 + np.exp(-np.clip(thresholds[np.minimum(rank, n_grades - 2)] - z, -30, 30))), 1.0)
        lower = np.where(low, 1 / (1 + np.exp(-np.clip(thresholds[np.maximum(rank - 1, 0)] - z, -30, 30))), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        pull = du - dl
        g = summed(inverse, lambda c: pull[row[c]] * value[c], len(kept)) / n
        speed += g * g
        step = 0.5 / np.sqrt(speed)
        weights -= step * g
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * l1, 0)
        slope = np.zeros(n_grades - 1)
        np.add.at(slope, rank[high], -du[high] / n)
        np.add.at(slope, rank[low] - 1, dl[low] / n)
        along = np.cumsum(slope[::-1])[::-1]
        along[1:] *= np.exp(base[1:])
        base_speed += along**2
        base -= 0.5 * along / np.sqrt(base_speed)
    out = np.zeros(size)
    out[kept] = weights
    return np.cumsum(np.concatenate([base[:1], np.exp(base[1:])])), out


def graded(model: OrdinalModel, text: Column, least: int) -> Column:
    """struct(expected, tail) of each text."""

    @F.arrow_udf("struct<expected: double, tail: double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            expected, tail = model.graded(t, least)
            yield pa.StructArray.from_arrays([pa.array(expected), pa.array(tail)], ["expected", "tail"])

    return run(text)
