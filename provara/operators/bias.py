"""Wording of a job text that shuts people out: a lexicon scan, seniority that contradicts the role, one finding a span."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provara.operators.views import inclusivity

# The order of severities, and years asked for.
SEVERITIES = ("critical", "high", "medium", "low")
YEARS = r"(\d+)\+?\s*years?(?:\s+of)?\s+experience"
LEAST_YEARS = 2

_FINDING = pa.list_(pa.struct([("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.string()), ("line", pa.string())]))


def line_at(text: Column, position: Column) -> Column:
    """The line around a position, without outer spaces."""
    before = F.element_at(F.split(F.substring(text, F.lit(1), position), "\n", -1), -1)
    after = F.element_at(F.split(F.substring(text, position + 1, F.length(text)), "\n", -1), 1)
    return F.regexp_replace(F.concat(before, after), r"(?U)^\s+|\s+$", "")


def matches(text: str | None, patterns: Sequence[str]) -> list[dict]:
    """Each pattern's matches in order, without those whose span an earlier one has."""
    found, seen = [], set()
    for seq, p in enumerate(patterns):
        for m in re.finditer(p, text or "", re.IGNORECASE):
            if m.span() in seen:
                continue
            seen.add(m.span())
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            line = text[start : end if end >= 0 else len(text)].strip()
            found.append({"seq": seq, "start": m.start(), "end": m.end(), "matched": m[0], "line": line})
    return found


def scanned(text: Column, patterns: Sequence[str]) -> Column:
    """Array of (seq, start, end, matched, line) of the lexicon's patterns; seq is the pattern's place. Patterns are Python's, so rows pass through Python in Arrow batches."""

    @F.arrow_udf("array<struct<seq: int, start: int, end: int, matched: string, line: string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([matches(t, patterns) for t in texts.to_pylist()], _FINDING)

    return run(text)


def lexicon_findings(docs: DataFrame, lexicon: Sequence[dict]) -> DataFrame:
    """doc_id, seq, category, severity, start, end, matched, line and suggestion of docs (doc_id, text).

    lexicon: category, severity, pattern and suggestion of each term, a small fixed list.
    """
    known = F.array(*(F.struct(*(F.lit(t[k]).alias(k) for k in ("category", "severity", "suggestion"))) for t in lexicon))
    rows = docs.select("doc_id", F.inline(scanned(F.col("text"), [t["pattern"] for t in lexicon])))
    return rows.withColumn("_t", F.get(known, F.col("seq"))).select("doc_id", "seq", "_t.category", "_t.severity", "start", "end", "matched", "line", "_t.suggestion")


def seniority(docs: DataFrame, months: DataFrame, junior: Sequence[str]) -> DataFrame:
    """doc_id, start, end, matched, years and impact_count: years of experience asked for by texts (doc_id, text) of junior roles.

    impact_count: how many of the pool (months: one row for each, column months) have fewer. The pool is summed up
    by months first, so it is as small as the longest career.
    """
    low = F.lower("text")
    is_junior = F.exists(F.array(*map(F.lit, junior)), lambda m: F.contains(low, m))
    found = docs.where(is_junior).select("doc_id", F.inline(scanned(F.col("text"), [YEARS])))
    found = found.withColumn("years", F.regexp_extract("matched", r"^(\d+)", 1).cast("long")).where(F.col("years") >= LEAST_YEARS)
    held = months.groupBy("months").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("months", "n")).alias("pool"))
    below = F.aggregate("pool", F.lit(0).cast("long"), lambda s, p: s + F.when(p["months"] < F.col("years") * 12, p["n"]).otherwise(0))
    out = found.join(F.broadcast(held), F.lit(True), "left")
    return out.select("doc_id", "start", "end", "matched", "years", F.coalesce(below, F.lit(0)).alias("impact_count"))


def one_for_each_span(findings: DataFrame) -> DataFrame:
    """findings (doc_id, severity, impact_count, start, end, seq, ...) without those that overlap a more severe one; those without a span (start below 0) stay.

    The order is severity, then falling impact_count, then seq.
    """
    rank = _severity_rank(F.col("severity"))
    columns = [F.col(c) for c in findings.columns]
    ordered = F.sort_array(F.collect_list(F.struct(rank.alias("_r"), (-F.col("impact_count")).alias("_i"), F.col("seq").alias("_s"), F.struct(*columns).alias("f"))))
    per_text = findings.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["f"]).alias("all"))
    free = lambda kept, f: (f["start"] < 0) | ~F.exists(kept, lambda k: (k["start"] >= 0) & (f["start"] < k["end"]) & (k["start"] < f["end"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, f: F.when(free(kept, f), F.array_append(kept, f)).otherwise(kept))
    return per_text.select(F.inline(kept))


def _severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)), F.lit(9))


def findings(docs: DataFrame, lexicon: Sequence[dict], junior: Sequence[str], months: DataFrame, impact: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, category, severity, impact_count, start, end and matched of all layers, one finding a span.

    docs: doc_id, text (null counts as empty); lexicon, junior and months as above; impact: doc_id, place, skill,
    excluded and pool, how many of a pool a requirement shuts out (a finding without a span, high if over half).
    seq tells the order of equals: the lexicon, seniority, then impact.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = len(lexicon)
    columns = ("doc_id", "seq", "category", "severity", "impact_count", "start", "end", "matched")
    out = lexicon_findings(docs, lexicon).withColumn("impact_count", F.lit(0).cast("long")).select(*columns)
    years = seniority(docs, months, junior)
    years = years.withColumns({"seq": F.lit(n), "category": F.lit("seniority"), "severity": F.lit("critical"), "impact_count": F.col("impact_count").cast("long")})
    out = out.unionByName(years.select(*columns))
    if impact is not None:
        severity = F.when(F.col("excluded") > F.floor(F.col("pool") / 2), "high").otherwise("medium")
        shut = impact.where("excluded > 0").select(
            "doc_id", (F.col("place") + n + 1).cast("int").alias("seq"), F.lit("impact").alias("category"), severity.alias("severity"),
            F.col("excluded").cast("long").alias("impact_count"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.col("skill").alias("matched"),
        )
        out = out.unionByName(shut)
    return one_for_each_span(out)


def report(docs: DataFrame, found: DataFrame, junior: Sequence[str]) -> DataFrame:
    """doc_id, score, n_findings, is_junior and summary of every document of docs (doc_id, text) from its findings()."""
    s = F.col("severity")
    worst = F.min(F.struct(_severity_rank(s).alias("r"), (-F.col("impact_count")).alias("i"), "seq", "category", "matched"))
    f = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"), worst.alias("worst")
    )
    f = f.join(inclusivity(found), "doc_id")
    d = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low")).join(f, "doc_id", "left")
    part = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}.")))
    head = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " finding").otherwise(" findings"), F.lit(", score "), F.col("score").cast("string"), F.lit(" of 100."))
    worst = F.concat(F.lit("The gravest, "), F.col("worst.category"), F.lit(": “"), F.col("worst.matched"), F.lit("”."))
    told = F.concat_ws(" ", head, part("critical", "critical"), part("high", "of high severity"), worst)
    is_junior = F.exists(F.array(*map(F.lit, junior)), lambda m: F.contains(F.col("_low"), m))
    return d.select(
        "doc_id", F.coalesce("score", F.lit(100).cast("long")).alias("score"), F.coalesce("n", F.lit(0)).alias("n_findings"),
        is_junior.alias("is_junior"), F.when(F.col("n").isNull(), "Nothing found in this text's wording.").otherwise(told).alias("summary"),
    )
