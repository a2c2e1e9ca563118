"""The evidence matrix and everything ranked from it.

cells: doc_id, skill, tier (REQUIRED or PREFERRED), weight, cluster, lex, lex_eff, sem_raw.
subs: doc_id, bm25_raw, docsim_raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provara.functions.numeric import CONFIG, calibrate, clip01, half_even, rounded, status
from provara.operators import selection
from provara.session import settled


def evidence_matrix(docs: DataFrame, skills: DataFrame, evidence: DataFrame) -> DataFrame:
    """One cell for each document and skill; skills is the short side, a requirement list."""
    full = docs.select("doc_id").join(F.broadcast(skills), F.lit(True)).join(evidence, ["doc_id", "skill"], "left")
    cells = full.select("doc_id", "skill", "tier", "weight", "cluster", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lex", "lex_eff", "sem_raw")))
    return worth(cells)


def worth(cells: DataFrame) -> DataFrame:
    cells = cells.withColumn("sem_cal", calibrate(F.col("sem_raw")))
    return cells.withColumns({"coverage": F.greatest("lex_eff", "sem_cal"), "status": status(F.col("lex"), F.col("sem_cal"))})


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top, F.lit(0.0)) / F.when(F.coalesce(bottom, F.lit(0.0)) == 0, 1.0).otherwise(bottom)


def rollups(cells: DataFrame) -> DataFrame:
    """Weighted coverages of each document, partially summed before the shuffle. With a column verdict, also how many claims are proven and contradicted."""
    required = F.col("tier") == "REQUIRED"
    w, of_required = F.col("weight"), F.when(required, F.col("weight"))
    told = {"n_proven": "CORROBORATED", "n_contradicted": "CONTRADICTED"} if "verdict" in cells.columns else {}
    return cells.groupBy("doc_id").agg(
        _ratio(F.sum(w * F.col("lex_eff")), F.sum(w)).alias("lex_cov"),
        _ratio(F.sum(w * F.col("lex")), F.sum(w)).alias("lex_cov_raw"),
        _ratio(F.sum(w * F.col("sem_cal")), F.sum(w)).alias("sem_cov"),
        _ratio(F.sum(of_required * F.col("coverage")), F.sum(of_required)).alias("req_coverage"),
        F.coalesce(F.bround(F.avg(F.when(F.col("lex") > 0, F.col("lex_eff") / F.col("lex"))), 4), F.lit(1.0)).alias("mean_worth"),
        F.count_if(F.col("status") == "MATCHED").alias("n_matched"),
        *(F.count_if(F.col("verdict") == v).alias(n) for n, v in told.items()),
    )


def placed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with ``name``, each row's place (from 1) in the order, which must be total.

    Rows are cut into ranges of the order and numbered within each; the sizes of earlier ranges, one row a
    range, are added. No task sees more than a range. The ranges are drawn from a sample, so they are written
    once for both readers.
    """
    dealt = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = dealt.withColumn("_place", within).join(F.broadcast(offsets), "_range")
    return out.withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_before")


def robust_norm(df: DataFrame, *columns: str) -> DataFrame:
    """Adds norm_<c>: between the 5th and 95th percentile of the pool, 0.5 if they are equal. The limits are numbers in the plan."""
    df = settled(df)
    limits = selection.percentiles(df, {c: (0.05, 0.95) for c in columns})
    out = df
    for c in columns:
        low, high = (F.lit(x).cast("double") for x in limits[c])
        out = out.withColumn(f"norm_{c}", F.when(high - low < 1e-9, 0.5).otherwise(clip01((F.col(c) - low) / (high - low))))
    return out


def primitives(cells: DataFrame, subs: DataFrame) -> DataFrame:
    """All that a score needs and no alpha changes."""
    c = CONFIG
    p = robust_norm(rollups(cells).join(subs, "doc_id"), "bm25_raw", "docsim_raw")
    k = F.lit(c.k_bm25) * F.col("norm_bm25_raw") + F.lit(1 - c.k_bm25) * F.col("lex_cov")
    m = F.lit(c.m_docsim) * F.col("norm_docsim_raw") + F.lit(1 - c.m_docsim) * F.col("sem_cov")
    return p.withColumns({"k": rounded(k, 9), "m": rounded(m, 9)})


def gate(enabled: bool = True) -> Column:
    return F.lit(CONFIG.gate_floor) + F.lit(CONFIG.gate_span) * F.col("req_coverage") if enabled else F.lit(1.0)


def scored(p: DataFrame, alpha: float | Column = 0.5, gated: bool = False) -> DataFrame:
    a = clip01(F.lit(alpha) if isinstance(alpha, float) else alpha)
    score = F.lit(100.0) * (a * F.col("k") + (1 - a) * F.col("m")) * gate(gated)
    if "doc_multiplier" in p.columns:
        score = score * F.coalesce("doc_multiplier", F.lit(1.0))
    return p.withColumn("score", half_even(score, 2))


def ranked(p: DataFrame, alpha: float = 0.5, gated: bool = False) -> DataFrame:
    """Scores, ranks of both channels (ties by doc_id), reciprocal-rank fusion and its rank, the flag and the final rank (ties by name, where p has one, then doc_id).

    Ranks are over the whole pool: only narrow columns are put in order, in ranges (placed).
    """
    c = CONFIG
    by_name = [F.coalesce("name", F.lit(""))] if "name" in p.columns else []
    s = scored(p, alpha, gated).select("doc_id", "k", "m", "score", "lex_cov_raw", "sem_cov", "req_coverage", *(["name"] if by_name else []))
    s = placed(placed(s, "rank_k", F.desc("k"), F.col("doc_id")), "rank_m", F.desc("m"), F.col("doc_id"))
    s = s.withColumn("rrf", F.lit(1.0) / (c.rrf_k + F.col("rank_k")) + F.lit(1.0) / (c.rrf_k + F.col("rank_m")))
    s = placed(placed(s, "rank_rrf", F.desc("rrf"), F.col("doc_id")), "rank", F.desc("score"), *by_name, F.col("doc_id"))
    s = s.join(F.broadcast(s.agg(F.count(F.lit(1)).alias("_pool"))), F.lit(True))
    delta = F.col("rank_k") - F.col("rank_m")
    ratio = F.abs(delta) / F.greatest("_pool", F.lit(1))
    gem = (delta >= c.flag_delta) & (ratio >= c.gem_ratio) & (F.col("req_coverage") >= c.gem_coverage)
    surface = F.col("lex_cov_raw") - F.col("sem_cov") >= c.surface_gap
    flag = F.when(gem, "HIDDEN_GEM").when(surface, "SURFACE_MATCH").otherwise("NONE")
    return s.withColumn("flag", flag).drop("_pool")


def leave_one_out(cells: DataFrame, p: DataFrame, top: int = 5) -> DataFrame:
    """For each required skill, how many enter the top without it. Sums without a skill are the sums less its cell; norms stay."""
    c = CONFIG
    less = cells.where("tier = 'REQUIRED'").select("doc_id", "skill", "weight", "lex_eff", "sem_cal")
    total = cells.groupBy("doc_id").agg(F.sum("weight").alias("all_w"))
    d = less.join(total, "doc_id").join(p.select("doc_id", "lex_cov", "sem_cov", "norm_bm25_raw", "norm_docsim_raw"), "doc_id")
    rest = F.when(F.col("all_w") - F.col("weight") == 0, 1.0).otherwise(F.col("all_w") - F.col("weight"))
    lex = (F.col("all_w") * F.col("lex_cov") - F.col("weight") * F.col("lex_eff")) / rest
    sem = (F.col("all_w") * F.col("sem_cov") - F.col("weight") * F.col("sem_cal")) / rest
    k = F.lit(c.k_bm25) * F.col("norm_bm25_raw") + F.lit(1 - c.k_bm25) * lex
    m = F.lit(c.m_docsim) * F.col("norm_docsim_raw") + F.lit(1 - c.m_docsim) * sem
    d = d.withColumn("score", F.round(F.lit(50.0) * (k + m), 6))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("score"), "doc_id"))).where(F.col("place") <= top)
    base = p.select("doc_id", F.round(F.lit(50.0) * (F.col("k") + F.col("m")), 6).alias("s")).orderBy(F.desc("s"), "doc_id").limit(top).select("doc_id")
    return d.join(F.broadcast(base.withColumn("was", F.lit(True))), "doc_id", "left").groupBy("skill").agg(F.count_if(F.col("was").isNull()).alias("entrants"), F.min("doc_id").alias("least_doc"))


def without(cells: DataFrame, p: DataFrame, drop: DataFrame) -> DataFrame:
    """Primitives of the pool as if the skills of drop (a requirement list) were not asked for; norms stay."""
    c = CONFIG
    rest = cells.join(F.broadcast(drop.select("skill").distinct()), "skill", "left_anti")
    kept = p.select("doc_id", "bm25_raw", "docsim_raw", "norm_bm25_raw", "norm_docsim_raw")
    out = kept.join(rollups(rest), "doc_id", "left").fillna(0.0, ["lex_cov", "lex_cov_raw", "sem_cov", "req_coverage"])
    k = F.lit(c.k_bm25) * F.col("norm_bm25_raw") + F.lit(1 - c.k_bm25) * F.col("lex_cov")
    m = F.lit(c.m_docsim) * F.col("norm_docsim_raw") + F.lit(1 - c.m_docsim) * F.col("sem_cov")
    return out.withColumns({"k": rounded(k, 9), "m": rounded(m, 9)})


def by_status(cells: DataFrame, *statuses: str) -> DataFrame:
    """Cells of the given statuses with their place in the document, strongest first."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc(F.round("coverage", 6)), F.lower(F.col("skill").cast("string")))
    return cells.where(F.col("status").isin(*statuses)).withColumn("place", F.row_number().over(order))


def discounted() -> Column:
    return (F.col("lex") > 0) & (F.col("lex_eff") < F.col("lex") - 1e-9)


def boosted() -> Column:
    return F.col("lex_eff") > F.col("lex") + 1e-9


def top_gaps(cells: DataFrame, n: int = 5) -> DataFrame:
    """The n gaps of each document that matter most."""
    order = Window.partitionBy("doc_id").orderBy(F.col("tier") != "REQUIRED", F.desc("weight"), F.round("coverage", 6), "skill")
    return cells.where(F.col("status").isin("WEAK", "MISSING")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def closed_gaps(cells: DataFrame, p: DataFrame) -> DataFrame:
    """Points gained at alpha 0.5 by closing each gap: the skill's lex and coverage become 1."""
    total = cells.groupBy("doc_id").agg(F.sum("weight").alias("all_w"))
    gaps = top_gaps(cells).join(total, "doc_id")
    gain = F.lit(50.0) * F.lit(1 - CONFIG.k_bm25) * F.col("weight") * (1 - F.col("lex_eff")) / F.col("all_w")
    return gaps.join(p.select("doc_id", "k", "m"), "doc_id").select("doc_id", "skill", F.round(gain, 4).alias("points"))


def compared(cells: DataFrame, a: int, b: int) -> DataFrame:
    """Skills that only one of two documents holds."""
    held = cells.where(F.col("status").isin("MATCHED", "INFERRED"))
    left, right = (held.where(F.col("doc_id") == i).select("skill", F.lit(i).cast("long").alias(x)) for i, x in ((a, "in_a"), (b, "in_b")))
    return left.join(right, "skill", "full_outer").where("in_a is null or in_b is null").select("skill", F.when(F.col("in_b").isNull(), "a").otherwise("b").alias("side"))
