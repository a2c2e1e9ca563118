"""Chunks, sections, requirements, wording, repositories and pool-wide order, by hand and against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provara.operators import bias, enrichment, fusion, judgement, requirements, sections, semantic, text

WORDS = ("ein", "built", "services", "Data", "pipelines", "e.g.", "v2.", "Done!", "(internal)", "größer", "why?", "x")


def made_text(r):
    lines = []
    for _ in range(r.randint(0, 12)):
        line = " ".join(r.choice(WORDS) for _ in range(r.choice((0, 2, 6, 60, 90))))
        lines.append(r.choice(("", "  ", "\t")) + line.replace(" x ", "  x \t") + r.choice(("", " ")))
    return "\n".join(lines)


def brute_chunks(t):
    out, offset = [], 0
    for line in t.split("\n"):
        bare = line.strip()
        cuts = [m.end(1) for m in re.finditer(r"([.!?])(?=\s+[A-Z(])", line)] if len(bare) > 180 else []
        for a, z in zip([0, *cuts], [*cuts, len(line)], strict=True):
            piece = line[a:z].strip()
            if len(bare) >= 25 and len(piece) >= 25:
                start = offset + a + len(line[a:z]) - len(line[a:z].lstrip())
                out.append((start, start + len(piece), piece))
        offset += len(line) + 1
    return out


def test_chunks_equal_brute_force_and_index_their_text(spark):
    r = random.Random(1)
    rows = [(i, made_text(r)) for i in range(60)] + [(99, None), (98, ""), (97, "\n".join("a line of some length, number " + str(i) for i in range(700)))]
    got = {}
    for x in text.chunks(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(x.doc_id, []).append((x.start, x.end, x.text))
    for i, t in rows:
        assert got.get(i, []) == brute_chunks(t or "")
        assert all(t[a:z] == piece for a, z, piece in got.get(i, []))


def test_sections_by_headers(spark):
    t = "Ann Lee\nWORK HISTORY:\nbuilt things\nEducaton\nsome school\nProjects\none\nTechnical Skills\nsql\nPersonal Projects\ntwo"
    got = {r.name: (r.seq, t[r.start : r.end]) for r in sections.sections(spark.createDataFrame([(1, t), (2, "no headers here, at all"), (3, None)], "doc_id long, text string")).collect()}
    assert got["EXPERIENCE"] == (0, "\nbuilt things\n") and got["EDUCATION"] == (1, "\nsome school\n") and got["SKILLS"][0] == 3
    assert got["PROJECTS"] == (2, "\none\nTechnical Skills\nsql\nPersonal Projects\ntwo") and len(got) == 4


def test_requirements_of_a_text(spark):
    job = "Required skills\nWe use Node and SQL daily\nNice to have\nGolang, Terraform 1.5 and Version control\nKafkaStreams is required\nAbout us\nFooBar"
    gz = spark.createDataFrame([("node.js", "Node.js", ["node"]), ("sql", "SQL", None), ("git", "Git", ["version control"]), ("go", "Go", ["golang"])], "skill string, label string, aliases array<string>")
    lines = spark.createDataFrame([(1, i, x, x.lower()) for i, x in enumerate(job.split("\n"))], "doc_id long, line_no int, line string, canonical string")
    got = {r.skill: r for r in requirements.extracted(lines, gz).collect()}
    assert {s: r.tier for s, r in got.items() if r.source == "gazetteer"} == {"node.js": "REQUIRED", "sql": "REQUIRED", "git": "PREFERRED", "go": "PREFERRED"}
    assert got["kafkastreams"].tier == "REQUIRED" and got["terraform"].label == "Terraform" and "foobar" not in got and "version" not in got
    ordered = sorted(got.values(), key=lambda r: r.place)
    assert [r.tier for r in ordered] == sorted((r.tier for r in ordered), reverse=True)
    told = requirements.summary(requirements.extracted(lines, gz)).first().text
    assert told.startswith(f"{len(got)} skills  (3 required, 3 preferred)\n  REQUIRED : KafkaStreams, Node.js, SQL\n  PREFERRED: ")


def test_place_over_ranges_is_the_place_in_order(spark):
    r = random.Random(2)
    rows = [(i, r.choice((0.0, 0.0, 0.0, r.random()))) for i in range(500)]
    got = fusion.placed(spark.createDataFrame(rows, "doc_id long, x double").repartition(7), "place", F.desc("x"), F.col("doc_id")).collect()
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda p: (-p[1], p[0])))}
    assert {g.doc_id: g.place for g in got} == want


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_percentiles_over_ranges_are_exact(spark, n):
    r = random.Random(n)
    xs = [r.choice((0.0, 5.0, r.uniform(-3, 9))) for _ in range(n)]
    low, high = np.percentile(xs, [5, 95])
    got = fusion.robust_norm(spark.createDataFrame([(x,) for x in xs], "x double").repartition(5), "x").collect()
    want = {x: 0.5 if high - low < 1e-9 else min(max((x - low) / (high - low), 0), 1) for x in xs}
    assert len(got) == n and all(abs(g.norm_x - want[g.x]) < 1e-9 for g in got)


def test_no_window_over_the_whole_pool(spark):
    p = spark.createDataFrame([(i, i / 9, 1 - i / 9, 0.5, 0.5, 0.5) for i in range(9)], "doc_id long, k double, m double, lex_cov_raw double, sem_cov double, req_coverage double")
    plan = fusion.ranked(p)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k" not in plan and "windowspecdefinition(score" not in plan


def test_hidden_text_lowers_the_score(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    spans = spark.createDataFrame([(1, i, "x" * 200, "size") for i in range(5)], "doc_id long, seq int, text string, reason string")
    r = {x.doc_id: x for x in judgement.hidden_report(docs, spans).collect()}
    assert r[1].hidden_flag and r[1].doc_multiplier == 0.4 and r[1].hidden_samples == ["x" * 90 + " (size)"] * 3 and not r[2].hidden_flag
    p = spark.createDataFrame([(1, 0.5, 0.5, 1.0), (2, 0.5, 0.5, 1.0)], "doc_id long, k double, m double, req_coverage double")
    assert {x.doc_id: x.score for x in fusion.scored(p.join(judgement.hidden_report(docs, spans), "doc_id")).collect()} == {1: 20.0, 2: 50.0}


def test_lexicon_and_spans(spark):
    job = "We need a rockstar ninja.\n  Young, energetic rockstar  \nends"
    lexicon = [
        {"category": "a", "severity": "medium", "pattern": r"\brockstar( ninja)?\b", "suggestion": "engineer"},
        {"category": "b", "severity": "high", "pattern": r"\bninja\b", "suggestion": "expert"},
        {"category": "c", "severity": "low", "pattern": r"\byoung\b|\brockstar\b", "suggestion": "x"},
    ]
    found = bias.lexicon_findings(spark.createDataFrame([(1, job), (2, None)], "doc_id long, text string"), lexicon)
    got = {(r.category, r.matched, r.line) for r in found.collect()}
    assert got == {("a", "rockstar ninja", "We need a rockstar ninja."), ("a", "rockstar", "Young, energetic rockstar"), ("b", "ninja", "We need a rockstar ninja."), ("c", "rockstar", "We need a rockstar ninja."), ("c", "Young", "Young, energetic rockstar")}
    whole = spark.createDataFrame([(1, 9, "z", "critical", -1, -1, "", "", "", 3)], "doc_id long, seq int, category string, severity string, start int, end int, matched string, line string, suggestion string, impact_count int")
    kept = bias.one_for_each_span(found.withColumn("impact_count", F.lit(0)).unionByName(whole)).collect()
    assert {(r.category, r.matched) for r in kept} == {("z", ""), ("b", "ninja"), ("a", "rockstar"), ("c", "Young"), ("c", "rockstar")}


def test_seniority_of_junior_roles(spark):
    jobs = spark.createDataFrame([(1, "Internship: 5+ years of experience and 1 year experience"), (2, "Senior: 5 years experience")], "doc_id long, text string")
    months = spark.createDataFrame([(m,) for m in (0, 12, 59, 60, 61)], "months int")
    got = bias.seniority(jobs, months, ("intern",)).collect()
    assert [(r.doc_id, r.years, r.impact_count, r.matched) for r in got] == [(1, 5, 3, "5+ years of experience")]


def test_repositories(spark):
    paths = spark.createDataFrame([("r", i, p) for i, p in enumerate(("Dockerfile", "a/b/package.json", "a/b/c/package.json", "k8s/x.yaml", "package.json", "a/package.json", "b/package.json", "c/package.json"))], "repo string, seq int, path string")
    needles = spark.createDataFrame([(0, "dockerfile", "docker"), (1, "k8s/", "kubernetes"), (2, "x.yaml", "yaml")], "seq int, needle string, skill string")
    assert {(r.path, r.skill) for r in enrichment.proving_files(paths, needles).collect()} == {("Dockerfile", "docker"), ("k8s/x.yaml", "kubernetes")}
    names = spark.createDataFrame([("package.json",)], "name string")
    assert [r.path for r in enrichment.manifests(paths, names).orderBy("place").collect()] == ["a/b/package.json", "package.json", "a/package.json", "b/package.json"]
    known = spark.createDataFrame([("react", "react"), ("go", "go")], "key string, skill string")
    readme = spark.createDataFrame([("r", "Uses React. Let's gopher")], "repo string, text string")
    assert [r.skill for r in enrichment.readme_claims(readme, known).collect()] == ["react"]
    proofs = spark.createDataFrame([(1, "go", "linkedin"), (1, "go", "github"), (1, "sql", "linkedin")], "doc_id long, skill string, source string")
    assert {(r.skill, r.n, r.multiplier) for r in enrichment.combined(proofs).collect()} == {("go", 2, 1.35), ("sql", 1, 1.08)}


def test_nearest_chunk_is_the_first_of_equals(spark):
    sims = spark.createDataFrame([(1, 3, "a", 0.5), (1, 2, "a", 0.5), (1, 1, "a", 0.1)], "doc_id long, chunk_idx long, skill string, sim double")
    assert semantic.best_chunks(sims).first().chunk_idx == 2
    lit = spark.createDataFrame([(1, "a", 1.0, 1)], "doc_id long, skill string, lex double, chunk_idx long")
    assert semantic.cited(lit, semantic.best_chunks(sims)).first().cite == 1


def test_folding_keeps_control_characters(spark):
    row = spark.createDataFrame([("x\x01keep\x01js",)], "t string").select(text.folded(F.col("t"), {"js": "javascript"}).alias("f")).first()
    assert row.f == "x\x01keep\x01javascript"
