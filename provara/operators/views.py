"""What is told about ranked documents: explanations, roadmaps, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provara.functions.numeric import CONFIG, half_even, rounded
from provara.operators import fusion
from provara.operators.text import ascii_edges
from provara.session import settled

# Penalties of findings by severity; any other severity counts as low.
PENALTY = {"critical": 30, "high": 12, "medium": 6, "low": 2}


def explained(cells: DataFrame, top: int = 3) -> DataFrame:
    """met, missing and the skills with the best evidence of each document."""
    best = F.slice(F.array_sort(F.collect_list(F.when(F.col("sem_raw") > 0, F.struct((-F.col("sem_raw")).alias("s"), "skill")))), 1, top)
    required = F.col("tier") == "REQUIRED"
    held = F.col("status").isin("MATCHED", "INFERRED")
    e = cells.groupBy("doc_id").agg(F.count_if(required & held).alias("met"), F.count_if(required & (F.col("status") == "MISSING")).alias("missing"), best.alias("b"))
    return e.select("doc_id", "met", "missing", F.array_join(F.transform("b", lambda x: x["skill"]), ", ").alias("best"))


def places(pool: DataFrame, trials: DataFrame) -> DataFrame:
    """trials (doc_id, score, ...) with new_rank: 1 + the rows of pool (doc_id, score) that stand before it by score, then doc_id, its own row aside.

    Pool and trials are put in one order, in ranges; a trial's place there, less its place among the trials
    alone, is how many of the pool stand before it.
    """
    t = settled(trials.withColumn("_t", F.monotonically_increasing_id()))
    order = (F.desc("score"), F.col("doc_id"), F.col("_pool"), F.col("_t"))
    mine = t.select("doc_id", "score", F.lit(0).alias("_pool"), "_t")
    both = pool.select("doc_id", "score", F.lit(1).alias("_pool"), F.lit(-1).cast("long").alias("_t")).unionByName(mine)
    among = fusion.placed(both, "_all", *order).where("_pool = 0").select("_t", "_all")
    alone = fusion.placed(mine, "_own", *order).select("_t", "_own")
    out = t.join(among, "_t").join(alone, "_t").join(pool.select("doc_id", F.col("score").alias("_was")), "doc_id", "left")
    own = F.coalesce((F.col("_was") > F.col("score")).cast("long"), F.lit(0))
    return out.withColumn("new_rank", F.col("_all") - F.col("_own") + 1 - own).drop("_t", "_all", "_own", "_was")


def roadmap(cells: DataFrame, p: DataFrame, steps: int = 3) -> DataFrame:
    """For each document the gaps worth closing: every one of the top gaps is tried, the three that gain the most places (then points) are taken, and of these the ones that gain nothing go."""
    now = fusion.ranked(p).select("doc_id", "k", "m", "score", "rank")
    total = cells.groupBy("doc_id").agg(F.sum("weight").alias("all_w"))
    gaps = fusion.top_gaps(cells).select("doc_id", "skill", "tier", "weight", "lex_eff").join(total, "doc_id").join(now.withColumnRenamed("score", "was"), "doc_id")
    gain = F.lit(1 - CONFIG.k_bm25) * F.col("weight") * (1 - F.col("lex_eff")) / F.col("all_w")
    trials = gaps.withColumn("score", half_even(F.lit(50.0) * (rounded(F.col("k") + gain, 9) + F.col("m")), 2)).select("doc_id", "skill", "tier", "rank", "was", "score")
    t = places(now.select("doc_id", "score"), trials)
    t = t.withColumns({"places": F.col("rank") - F.col("new_rank"), "points": F.round(F.col("score") - F.col("was"), 2)})
    order = Window.partitionBy("doc_id").orderBy(F.desc("places"), F.desc("points"), F.col("tier") != "REQUIRED", "skill")
    return t.withColumn("step", F.row_number().over(order)).where((F.col("step") <= steps) & ((F.col("places") > 0) | (F.col("points") > 0))).select("doc_id", "skill", "step", "places", "points")


def rejected(ranked: DataFrame, cut: int, limit: int) -> DataFrame:
    """Documents below the cut, with what they lack to its score."""
    score = ranked.where(F.col("rank") == cut).agg(F.max("score").alias("cut_score"))
    return ranked.where(F.col("rank") > cut).orderBy("rank").limit(limit).join(F.broadcast(score), F.lit(True)).select("doc_id", "rank", "score", F.round(F.col("cut_score") - F.col("score"), 2).alias("short"))


def missing(cells: DataFrame) -> DataFrame:
    """What each document lacks: required skills it misses, weak ones, inferred ones, and required coverage in percent."""
    pick = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("skill")))), ", ")
    s, required = F.col("status"), F.col("tier") == "REQUIRED"
    of = lambda v: F.sum(F.when(required, v))
    share = of(F.col("weight") * F.col("coverage")) / of(F.col("weight"))
    return cells.groupBy("doc_id").agg(pick((s == "MISSING") & required).alias("missing"), pick(s == "WEAK").alias("weak"), pick(s == "INFERRED").alias("inferred"), F.round(F.round(100 * F.coalesce(share, F.lit(0.0)), 10), 4).alias("covered"))


def who_has(cells: DataFrame, ranked: DataFrame, skill: str) -> DataFrame:
    """Holders of one skill with how they hold it, in rank order."""
    held = cells.where((F.col("skill") == skill) & F.col("status").isin("MATCHED", "INFERRED"))
    return held.select("doc_id", "status").join(ranked.select("doc_id", "rank"), "doc_id")


def top_asked(question: Column, pool: Column) -> Column:
    """How many a question asks for: its number, else 3, at least 1 and at most the pool."""
    n = F.regexp_extract(F.lower(question), ascii_edges(r"\btop\s*(\d{1,9})"), 1)
    return F.least(F.greatest(F.when(n == "", 3).otherwise(n.try_cast("int")), F.lit(1)), pool.cast("int"))


def questions(cells: DataFrame, verdicts: DataFrame, difficulty: DataFrame) -> DataFrame:
    """Up to three interview questions of each document: at most two on required gaps worth probing, two on contradicted claims, one on an inferred skill."""
    c = cells.join(verdicts, ["doc_id", "skill"], "left").join(F.broadcast(difficulty), "skill", "left")
    hard = (F.coalesce("difficulty", F.lit(3)) >= 3) | (F.coalesce("verdict", F.lit("")) == "CONTRADICTED")
    kind = F.when(F.col("status").isin("MISSING", "WEAK") & (F.col("tier") == "REQUIRED") & hard, "GAP").when(F.col("verdict") == "CONTRADICTED", "CLAIM").when(F.col("status") == "INFERRED", "INFERRED")
    c = c.withColumn("kind", kind).where("kind is not null").withColumn("branch", F.when(F.col("kind") == "GAP", 0).when(F.col("kind") == "CLAIM", 1).otherwise(2))
    own = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.desc("weight"), F.round("coverage", 6), "skill"))
    c = c.withColumn("own", own).where(F.col("own") <= F.when(F.col("kind") == "INFERRED", 1).otherwise(2))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("branch", "own"))).where("place <= 3").select("doc_id", "place", "kind", "skill")


def inclusivity(findings: DataFrame) -> DataFrame:
    """score of each text from its findings (doc_id, severity)."""
    cost = F.sum(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PENALTY.items() for x in kv)), F.col("severity")), F.lit(PENALTY["low"])))
    return findings.groupBy("doc_id").agg(F.greatest(F.lit(0), F.lit(100) - cost).cast("long").alias("score"))
