"""Scalar formulas of the ranking model, with its constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Fixed values of the model."""

    k_bm25: float = 0.40
    m_docsim: float = 0.25
    docsim_top: int = 3
    cal_low: float = 0.20
    cal_high: float = 0.55
    matched: float = 0.8
    inferred: float = 0.55
    weak: float = 0.25
    gate_floor: float = 0.60
    gate_span: float = 0.40
    rrf_k: int = 60
    flag_delta: float = 6.0
    gem_ratio: float = 0.15
    gem_coverage: float = 0.60
    surface_gap: float = 0.40
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    recency_full: float = 12.0
    recency_floor: float = 0.55
    recency_half: float = 30.0


CONFIG = Config()


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many decimals, halves away from zero, judged by x * 10 ** digits as SQL databases do; F.round judges the shortest decimal form, which tells some halves otherwise."""
    size = F.abs(x) * 10.0**digits
    whole = F.floor(size).cast("double")
    return F.signum(x) * (whole + (size - whole >= 0.5).cast("double")) / 10.0**digits


def half_even(x: Column, digits: int) -> Column:
    """rounded(), but halves to the even neighbour."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def calibrate(x: Column, c: Config = CONFIG) -> Column:
    """Cosine to 0..1 between the two calibration points."""
    return clip01((x - c.cal_low) / F.lit(c.cal_high - c.cal_low))


def status(lex: Column, sem_cal: Column, c: Config = CONFIG) -> Column:
    return F.when(lex >= c.matched, "MATCHED").when(sem_cal > c.inferred, "INFERRED").when(sem_cal > c.weak, "WEAK").otherwise("MISSING")


def recency(age: Column, c: Config = CONFIG) -> Column:
    """1 while fresh, then halving toward the floor."""
    return F.when(age <= c.recency_full, 1.0).otherwise(F.lit(c.recency_floor) + F.lit(1 - c.recency_floor) * F.pow(F.lit(0.5), (age - c.recency_full) / c.recency_half))
