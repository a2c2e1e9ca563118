"""Sentences that say what the numbers mean, and views made of several of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provara.functions.numeric import CONFIG
from provara.operators import fusion
from provara.operators.text import listed, trimmed

# Cuts and words of the sentences.
FULL_MONTHS, WHOLE_WORTH = 12, 0.995
SHORT_WEEKS, MODERATE_WEEKS, NAMED_GAPS = 2.0, 6.0, 3
SHAPES = {
    "short": "productive on the full stack almost immediately",
    "moderate": "productive on their strengths from day one, fully ramped within the internship",
    "long": "would spend a meaningful part of the internship learning rather than shipping",
}
QUESTION_PARTS = (
    ("GAP", "probe the gaps"),
    ("CLAIM", "test the unsupported claims"),
    ("INFERRED", "confirm what they never named"),
    ("PROJECT", "go into their code"),
)


def plural(n: Column, word: str) -> Column:
    return F.when(n == 1, word).otherwise(f"{word}s")


def context_reason(section: Column, worth: Column, bare: Column, stamp: Column, horizon: Column) -> Column:
    """Where a claim was found and how old it is; worth is section weight x recency, stamps are year * 12 + month (1 to 12)."""
    where = (
        F.when(section == "SKILLS", "in the self-declared skills list")
        .when(section == "EDUCATION", "in coursework")
        .when(section.isin("EXPERIENCE", "PROJECTS"), F.concat(F.lit("in worked "), F.lower(section)))
        .when(section != "UNKNOWN", F.concat(F.lit("in "), F.lower(section)))
    )
    year = F.floor((stamp - 1) / 12).cast("string")
    age = F.greatest(horizon - stamp, F.lit(0))
    years = F.floor(age / 12)
    recent = F.concat(F.lit("dated "), year, F.lit(", within the last year of this resume"))
    older = F.concat(F.lit("dated "), year, F.lit(", about "), years.cast("string"), F.lit(" "), plural(years, "year"), F.lit(" back"))
    dated = F.when(stamp.isNotNull(), F.when(age <= FULL_MONTHS, recent).otherwise(older))
    parts = F.array_compact(F.array(where, F.when(bare, "as a bare tag with no surrounding context"), dated))
    verdict = F.when((worth >= WHOLE_WORTH) & ~bare, "counted in full").otherwise("discounted")
    told = F.concat(F.lit("Found "), F.array_join(parts, ", "), F.lit(" — "), verdict, F.lit("."))
    return F.when(F.size(parts) == 0, "No section or date context available; counted at face value.").otherwise(told)


def channel_line() -> Column:
    """What the two channels say of a row of fusion.ranked()."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    base = F.concat(F.lit("Keyword channel "), two("k"), F.lit(", semantic channel "), two("m"))
    delta = F.abs(F.col("rank_k") - F.col("rank_m"))
    gem = F.concat(
        base,
        F.lit(
            ". Flagged HIDDEN GEM: required skills are demonstrably practised but not stated in the job description's "
            "vocabulary, so a keyword-only filter would rank this candidate "
        ),
        delta.cast("string"), F.lit(" "), plural(delta, "place"), F.lit(" lower than the evidence warrants."),
    )
    surface = F.concat(
        base,
        F.lit(
            ". Flagged SURFACE MATCH: the resume names the required skills but shows little supporting work, so lexical "
            "coverage runs well ahead of semantic coverage. Worth probing in interview."
        ),
    )
    ranks = [F.lit("#"), F.col("rank_k").cast("string"), F.lit(", semantic #"), F.col("rank_m").cast("string"), F.lit(").")]
    agree = F.concat(base, F.lit(". Both channels agree (lexical "), *ranks)
    return F.when(F.col("flag") == "HIDDEN_GEM", gem).when(F.col("flag") == "SURFACE_MATCH", surface).otherwise(agree)


def relation_reason(kind: Column, shared: Column, source: Column, target: Column) -> Column:
    """Why a step from one skill to another costs what it does."""
    return (
        F.when(kind == "sibling", F.concat(F.lit("Both are "), shared, F.lit("; the concepts carry over and the syntax is the delta.")))
        .when(kind == "family", F.concat(F.lit("Same family ("), shared, F.lit(") — the model transfers, the API surface does not.")))
        .when(kind == "domain", F.concat(F.lit("Shared ground is "), shared, F.lit("; the ecosystem around it is new.")))
        .when(
            kind == "discipline",
            F.concat(source, F.lit(" and "), target, F.lit(" only meet at "), shared, F.lit(" — this is a change of discipline, not a change of tool.")),
        )
        .otherwise("No adjacent experience on the resume.")
    )


def ramp_up(gaps: DataFrame, weeks: DataFrame) -> DataFrame:
    """doc_id, verdict and headline of each document of weeks (doc_id, weeks, human); gaps: doc_id, place, skill, tier."""
    shown = lambda t: F.transform(F.sort_array(F.collect_list(F.when(t, F.struct("place", "skill")))), lambda x: x["skill"].cast("string"))
    g = gaps.groupBy("doc_id").agg(shown(F.col("tier") == "REQUIRED").alias("required"), shown(F.lit(True)).alias("all"))
    rows = weeks.join(g, "doc_id", "left").withColumn("asked", F.size("required") > 0)
    rows = rows.withColumn("shown", F.when(F.col("asked"), F.col("required")).otherwise(F.col("all")))
    verdict = F.when(F.col("all").isNull(), "ready").when(F.col("weeks") <= SHORT_WEEKS, "short").when(F.col("weeks") <= MODERATE_WEEKS, "moderate").otherwise("long")
    n = F.size("shown")
    names = F.array_join(F.slice("shown", 1, NAMED_GAPS), ", ")
    names = F.when(n > NAMED_GAPS, F.concat(names, F.lit(" and "), (n - NAMED_GAPS).cast("string"), F.lit(" more"))).otherwise(names)
    shape = F.try_element_at(F.create_map(*(F.lit(x) for kv in SHAPES.items() for x in kv)), verdict)
    tier = F.when(F.col("asked"), "required").otherwise("preferred")
    told = F.concat(n.cast("string"), F.lit(" "), tier, F.lit(" "), plural(n, "gap"), F.lit(" ("), names, F.lit(") — about "), F.col("human"), F.lit(" to bridge, "), shape, F.lit("."))
    ready = "Meets every requirement the JD states — no ramp-up needed."
    return rows.select("doc_id", verdict.alias("verdict"), F.when(F.col("all").isNull(), ready).otherwise(told).alias("headline"))


def probes(cells: DataFrame, of_skill: DataFrame, of_cluster: DataFrame, other: str) -> DataFrame:
    """cells (skill, cluster, ...) with probe: the skill's (skill, probe), else its cluster's (cluster, probe), else other; both are dimensions."""
    by_skill = F.broadcast(of_skill.select("skill", F.col("probe").alias("_s")))
    by_cluster = F.broadcast(of_cluster.select("cluster", F.col("probe").alias("_c")))
    out = cells.join(by_skill, "skill", "left").join(by_cluster, "cluster", "left")
    return out.withColumn("probe", F.coalesce("_s", "_c", F.lit(other))).drop("_s", "_c")


def questions_headline(questions: DataFrame) -> DataFrame:
    """doc_id and headline of questions (doc_id, kind)."""
    said = F.array_compact(F.array(*(F.when(F.count_if(F.col("kind") == k) > 0, words) for k, words in QUESTION_PARTS)))
    n = F.count(F.lit(1)).cast("string")
    return questions.groupBy("doc_id").agg(F.concat(n, F.lit(" questions to "), F.array_join(said, ", "), F.lit(".")).alias("headline"))


def decisive(cells: DataFrame, a: int, b: int) -> DataFrame:
    """skill, in_a, in_b and place of the skills that only one of two documents holds, heaviest first."""
    held = F.col("status").isin("MATCHED", "INFERRED")
    two = cells.where(F.col("doc_id").isin(a, b))
    has = lambda i: F.coalesce(F.bool_or(F.when(F.col("doc_id") == i, held)), F.lit(False))
    each = two.groupBy("skill").agg(F.max("weight").alias("weight"), has(a).alias("in_a"), has(b).alias("in_b")).where("in_a != in_b")
    # as many rows as there are requirements
    return each.select("skill", "in_a", "in_b", F.row_number().over(Window.orderBy(F.desc("weight"), "skill")).alias("place"))


def combined_steps(steps: DataFrame, cells: DataFrame, p: DataFrame) -> DataFrame:
    """doc_id, n_steps and points that closing all of a document's steps (doc_id, skill) at once is worth, at alpha 0.5."""
    total = cells.groupBy("doc_id").agg(F.sum("weight").alias("all_w"))
    own = steps.select("doc_id", "skill").distinct().join(cells.select("doc_id", "skill", "weight", "lex_eff"), ["doc_id", "skill"])
    gain = F.sum(F.col("weight") * (1 - F.col("lex_eff")))
    sums = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_steps"), gain.alias("gain")).join(total, "doc_id").join(p.select("doc_id"), "doc_id")
    return sums.select("doc_id", "n_steps", F.round(F.lit(50.0) * F.lit(1 - CONFIG.k_bm25) * F.col("gain") / F.col("all_w"), 4).alias("points"))


def scatter(scores: DataFrame) -> DataFrame:
    """doc_id, x and y, each 0 to 1, of scores (doc_id, score, gap_density): the score axis ends at 100 or the best score."""
    top = scores.agg(F.greatest(F.lit(100.0), F.max("score")).alias("_top"))
    out = scores.join(F.broadcast(top), F.lit(True))
    return out.select("doc_id", (F.col("score") / F.col("_top")).alias("x"), F.least(F.greatest("gap_density", F.lit(0.0)), F.lit(1.0)).alias("y"))


def suggestions(first: str, second: str | None) -> list[str]:
    """Questions to put to a pool whose first two documents have these names."""
    second = second or first
    return [f"Why is {first} ranked above {second}?", f"Why did {first} rank first?", f"What is {second} missing?", "Who knows Docker?", "Show me the top 5"]


#: How many names a sentence lists, passages are quoted, and below what quality a text's reading is doubted.
MOST_STATED, MOST_WEAK, MOST_COMPARED, MOST_QUOTED, LEAST_QUALITY = 8, 5, 6, 3, 0.5


def _told(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _percent(x: Column) -> Column:
    return F.floor(100 * x + 1e-9).cast("string")


def explanations(cells: DataFrame, ranked: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """doc_id, headline and bullets (sentences) of every document of ranked.

    cells: as in fusion.py, with kind (near: matched through another spelling) and text (the cited passage), both
    may be null; quality: doc_id, quality of the text's reading. Lists are in order of weight, coverage and name.
    """
    own = fusion.by_status(cells, "MATCHED", "INFERRED", "WEAK", "MISSING")
    of = lambda c, *more: F.sort_array(F.collect_list(F.when(c, F.struct("place", *more, "skill"))))
    s, required = F.col("status"), F.col("tier") == "REQUIRED"
    best = F.sort_array(F.collect_list(F.when((s == "MATCHED") & required, F.struct((-F.col("sem_raw")).alias("far"), "place", "skill"))))
    g = own.groupBy("doc_id").agg(
        F.count_if(required).alias("asked"), F.count_if(required & s.isin("MATCHED", "INFERRED")).alias("met"), best.alias("best"),
        of(s == "MATCHED").alias("matched"), of((s == "MATCHED") & (F.col("kind") == "near")).alias("near"),
        of(s == "INFERRED", "sem_raw", "text").alias("inferred"), of((s == "MISSING") & required).alias("missing"), of(s == "WEAK").alias("weak"),
    )
    r = ranked.join(g, "doc_id", "left").join(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("pool"))), F.lit(True))
    r = r.withColumn("quality", F.lit(None).cast("double")) if quality is None else r.join(quality.select("doc_id", "quality"), "doc_id", "left")
    names = lambda c: F.transform(c, lambda x: x["skill"].cast("string"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    asked = F.coalesce("asked", F.lit(0))
    first = _told("Ranked #", F.col("rank"), " of ", F.col("pool"), " with ", F.format_string("%.2f", "score"), " points. Meets ", F.coalesce("met", F.lit(0)), " of ", asked, " required ", plural(asked, "skill"))
    above = F.when(count("best") > 0, F.concat(F.lit(", above all "), listed(names(F.slice("best", 1, 3))))).otherwise("")
    respelt = F.when(count("near") > 0, _told(" Through another spelling: ", listed(names("near")), ".")).otherwise("")
    stated = F.when(count("matched") > 0, _told("Names ", count("matched"), " ", plural(count("matched"), "skill"), ": ", listed(names("matched"), limit=MOST_STATED), ".", respelt))
    quote = lambda x: F.when(x["text"].isNull(), ".").otherwise(F.concat(F.lit(": “"), trimmed(x["text"]), F.lit("”")))
    quoted = F.transform(F.slice("inferred", 1, MOST_QUOTED), lambda x: _told(x["skill"], " is not named, but a passage comes near (", _percent(x["sem_raw"]), "%)", quote(x)))
    gaps = F.when(count("missing") > 0, _told("No evidence of ", count("missing"), " required ", plural(count("missing"), "skill"), ": ", listed(names("missing")), "."))
    weak = F.when(count("weak") > 0, _told("Comes near only: ", listed(names("weak"), limit=MOST_WEAK), "."))
    doubt = F.when(F.col("quality") < LEAST_QUALITY, _told("The text was read badly (", _percent(F.col("quality")), "%): look at the file itself."))
    line = channel_line()
    no_list = F.array().cast("array<string>")
    bullets = F.array_compact(F.concat(F.array(stated), F.coalesce(quoted, no_list), F.array(gaps, weak, line, doubt)))
    return r.select("doc_id", F.concat(first, above, F.lit(".")).alias("headline"), bullets.alias("bullets"))


def comparison(cells: DataFrame, ranked: DataFrame, a: int, b: int) -> DataFrame:
    """One row: winner, loser (doc_id), points, and lines, of two documents of ranked; no row if one of them is missing or they are the same.

    The winner has the higher score; of equals it is a.
    """
    two = ranked.where(F.col("doc_id").isin(a, b))
    row = F.struct(*(F.col(c) for c in ("doc_id", "score", "k", "m", "req_coverage", "flag", "rank_k", "rank_m")))
    pair = two.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), (F.col("doc_id") != a).alias("o"), row.alias("r")))).alias("p")).where(F.size("p") == 2)
    pair = pair.select(F.col("p")[0]["r"].alias("w"), F.col("p")[1]["r"].alias("l"))
    held = F.col("status").isin("MATCHED", "INFERRED")
    own = fusion.by_status(cells.where(F.col("doc_id").isin(a, b)), "MATCHED", "INFERRED", "WEAK", "MISSING")
    # cells of two documents: as many as there are requirements
    has = lambda i: F.coalesce(F.bool_or(held & (F.col("doc_id") == i)), F.lit(False))
    each = own.groupBy("skill").agg(F.max("weight").alias("weight"), has(a).alias("in_a"), has(b).alias("in_b"))
    only = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct((-F.col("weight")).alias("far"), F.lower(F.col("skill").cast("string")).alias("low"), F.col("skill").cast("string").alias("s"))))), lambda x: x["s"])
    sides = each.agg(only(F.col("in_a") & ~F.col("in_b")).alias("a_only"), only(F.col("in_b") & ~F.col("in_a")).alias("b_only"))
    d = pair.join(F.broadcast(sides), F.lit(True))
    first = F.col("w.doc_id") == a
    w_only, l_only = F.when(first, F.col("a_only")).otherwise(F.col("b_only")), F.when(first, F.col("b_only")).otherwise(F.col("a_only"))
    two_digits = lambda c: F.format_string("%.2f", F.round(c, 2))
    delta = lambda c: F.format_string("%+.2f", F.round(F.col(f"w.{c}") - F.col(f"l.{c}"), 2))
    channel = lambda c: _told(two_digits(F.col(f"w.{c}")), " to ", two_digits(F.col(f"l.{c}")), " (", delta(c), ")")
    covers = lambda x, names: F.when(F.size(names) > 0, _told("Only ", F.col(f"{x}.doc_id"), " covers ", listed(names, limit=MOST_COMPARED), "."))
    noted = lambda x: F.when(F.col(f"{x}.flag") == "HIDDEN_GEM", _told(F.col(f"{x}.doc_id"), " is a hidden gem: #", F.col(f"{x}.rank_m"), " by meaning, #", F.col(f"{x}.rank_k"), " by words.")).when(F.col(f"{x}.flag") == "SURFACE_MATCH", _told(F.col(f"{x}.doc_id"), " is a surface match: named, hardly shown."))
    points = F.round(F.col("w.score") - F.col("l.score"), 2)
    lines = F.array_compact(F.array(
        _told(F.col("w.doc_id"), " stands above ", F.col("l.doc_id"), " by ", F.format_string("%.2f", points), " points (", F.format_string("%.2f", "w.score"), " to ", F.format_string("%.2f", "l.score"), ")."),
        _told("By words ", channel("k"), ", by meaning ", channel("m"), "."),
        covers("w", w_only), covers("l", l_only),
        F.when((F.size("a_only") == 0) & (F.size("b_only") == 0), "Both cover the same skills; the evidence differs in depth."),
        _told("Required skills covered: ", _percent(F.col("w.req_coverage")), "% to ", _percent(F.col("l.req_coverage")), "%."),
        noted("w"), noted("l"),
    ))
    return d.select(F.col("w.doc_id").alias("winner"), F.col("l.doc_id").alias("loser"), points.alias("points"), lines.alias("lines"))
