"""Values at exact ranks of columns of any length, by intervals that counts narrow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An interval of so many rows is read; a wider one is narrowed first, to about 2 / ACCURACY of its rows.
READ, ACCURACY = 20_000, 10_000


@dataclass
class _Wanted:
    """The value at a rank (from 0) among a column's values between low and high, neither of them included."""

    column: str
    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        x = F.col(self.column)
        return x.isNotNull() & (F.lit(True) if self.low is None else x > self.low) & (F.lit(True) if self.high is None else x < self.high)


def _read(df: DataFrame, wanted: Sequence[_Wanted]) -> None:
    lists = df.agg(*(F.sort_array(F.collect_list(F.when(w.inside(), F.col(w.column)))).alias(f"v{i}") for i, w in enumerate(wanted))).first()
    for w, values in zip(wanted, lists, strict=True):
        w.value = values[w.rank]


def _narrow(df: DataFrame, wanted: Sequence[_Wanted]) -> None:
    shares = [[min(max((w.rank + 0.5) / w.n + d / ACCURACY, 0.0), 1.0) for d in (-1, 1)] for w in wanted]
    spots = df.agg(*(F.percentile_approx(F.when(w.inside(), F.col(w.column)), s, ACCURACY).alias(f"s{i}") for i, (w, s) in enumerate(zip(wanted, shares, strict=True)))).first()
    counts = []
    for w, (a, b) in zip(wanted, spots, strict=True):
        x = F.col(w.column)
        counts += [F.count_if(w.inside() & test) for test in (x < a, x == a, (x > a) & (x < b), (x == b) & F.lit(b != a))]
    found = df.agg(*(c.alias(f"c{i}") for i, c in enumerate(counts))).first()
    for i, (w, (a, b)) in enumerate(zip(wanted, spots, strict=True)):
        below, at_a, between, at_b = found[4 * i : 4 * i + 4]
        if w.rank < below:
            w.high, w.n = a, below
        elif w.rank < below + at_a:
            w.value = a
        elif w.rank < below + at_a + between:
            w.low, w.high, w.rank, w.n = a, b, w.rank - below - at_a, between
        elif w.rank < below + at_a + between + at_b:
            w.value = b
        else:
            passed = below + at_a + between + at_b
            w.low, w.rank, w.n = b, w.rank - passed, w.n - passed


def percentiles(df: DataFrame, shares: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact percentiles of each column with linear interpolation, null where a column has no values.

    All columns and shares are told by the same passes: one counts, and while an interval holds more than READ
    rows two more narrow it; the last reads what the intervals hold. Nothing is written or shuffled but counts,
    sketches and at most READ values for each share. df is read some times over, so it should be a table.
    """
    n = df.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(shares))).first()
    wanted: dict[tuple[str, int], _Wanted] = {}
    for c, total in zip(shares, n, strict=True):
        for s in shares[c]:
            for rank in {floor(s * (total - 1)), ceil(s * (total - 1))} if total else ():
                wanted.setdefault((c, rank), _Wanted(c, rank, total))
    while wide := [w for w in wanted.values() if w.value is None and w.n > READ]:
        _narrow(df, wide)
    if rest := [w for w in wanted.values() if w.value is None]:
        _read(df, rest)
    out: dict[str, list[float | None]] = {}
    for c, total in zip(shares, n, strict=True):
        out[c] = []
        for s in shares[c]:
            at = s * (total - 1)
            low, high = (wanted[c, f(at)].value for f in (floor, ceil)) if total else (None, None)
            out[c].append(low + (at - floor(at)) * (high - low) if total else None)
    return out
