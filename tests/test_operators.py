"""Operators against brute force and by hand on small tables."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from provara.operators import judgement, matching, redaction, taxonomy, text, views
from provara.plans import catalog, judged
from provara.plans.service import NoPool, Service
from provara.session import bounded
from provara.sources import documents
from provara.streaming import arrivals


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, ""), ("", ""), ("• ﬁrst\r\n\r\n\r\n\r\n– two   spaces", "first\n\ntwo spaces"), ("develop-\n  ment", "development"), ("a\x00b c", "a b c"), ("①", unicodedata.normalize("NFKC", "①"))],
)
def test_repair(spark, raw, want):
    assert one(spark, text.repaired(F.col("t")), t=raw) == want


def test_fold_takes_longest_and_never_its_own_output(spark):
    table = {"node": "node.js", "js": "javascript", "node js": "node.js", "c++": "cpp"}
    assert one(spark, text.folded(F.col("t"), table), t="Node JS, js; nodes C++ node") == "node.js, javascript; nodes cpp node.js"


def test_names_lists_and_spans(spark):
    assert one(spark, text.display_name(F.lit("c01_aarav_mehta"), F.col("t")), t="resume of x\n12\n") == "Aarav Mehta"
    assert one(spark, text.display_name(F.lit("c01"), F.col("t")), t="x\nAnn B. O'Neil\n") == "Ann B. O'Neil"
    said = [one(spark, text.listed(F.array(*map(F.lit, "ABCDE"[:n])), limit=3)) for n in range(1, 6)]
    assert said == ["A", "A and B", "A, B and C", "A, B, C and 1 more", "A, B, C and 2 more"]
    assert one(spark, text.around(F.col("t"), F.lit(1), F.lit(9)), t="abc") is None


def test_redaction(spark):
    t = "Ann Lee, ann@x.org, +91 98765 43210\nIIT Delhi 2019 - 2023\ngithub.com/ann/12345678 age: 31"
    r = redaction.redact_text(t, "Ann Lee", (37, 60))
    assert "[CANDIDATE], [EMAIL], [PHONE]" in r["text"] and "[GRADUATION YEAR]" in r["text"] and "github.com/ann/12345678" in r["text"]
    assert all(a["end"] <= b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    row = spark.createDataFrame([(t, "Ann Lee"), (None, None)], "t string, n string").select(redaction.redacted(F.col("t"), F.col("n"), F.lit(37), F.lit(60)).alias("r"), redaction.masked(F.col("t")).alias("m")).collect()
    assert row[0].r.text == r["text"] and row[1].r.text == "" and "[PORTFOLIO]" in row[0].m


def brute_ratio(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(now[-1], last[j + 1]))
        last = now
    return 200 * last[-1] / (len(a) + len(b)) if a and b else 0.0


def test_fuzzy_equals_brute_force(spark):
    terms = ["kubernetes", "kubernets", "kubernetse", "postgres", "postgresql", "a", "", "tensorflow", "tensor flow", "pytorch", "pytorhc", "javascript", "java"]
    got = matching.fuzzy(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in terms], "form string")).collect()
    want = {(a, b) for a in terms for b in terms if brute_ratio(a, b) >= 88}
    assert {(r.term, r.form) for r in got} == want and all(abs(r.similarity - brute_ratio(r.term, r.form)) < 1e-5 for r in got)


def test_all_bigrams_keep_rare_ones(spark, tmp_path):
    spark.createDataFrame([(1, "red green blue"), (2, "red green")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.bigram: r.n for r in catalog.QUERIES["T06_all_bigrams"](spark, str(tmp_path)).collect()}
    assert got == {"red green": 2, "green blue": 1}


def test_near_hits_take_bigrams_and_the_first_chunk(spark):
    rows = [(1, 0, "no such thing"), (1, 1, "one data base here"), (1, 2, "a databse"), (2, 0, "databse"), (2, 1, "the database"), (3, 0, "databaes databse pyton"), (None, 0, "databse")]
    chunks = spark.createDataFrame([(i, c, t, t.split()) for i, c, t in rows], "doc_id long, chunk_idx int, canonical string, tokens array<string>")
    forms = spark.createDataFrame([("db", "database", 0), ("py", "python", 0)], "skill string, form string, seq int")
    got = {(r.doc_id, r.skill, r.chunk_idx, r.form, r.term) for r in matching.near_hits(chunks, forms).collect()}
    assert got == {(1, "db", 1, "database", "data base"), (3, "db", 0, "database", "databse"), (3, "py", 0, "python", "pyton"), (None, "db", 0, "database", "databse")}


def test_literal_needs_edges_and_takes_first(spark):
    chunks = spark.createDataFrame([(1, 0, "javascript"), (1, 1, "uses java, sql"), (1, 2, "java")], "doc_id long, chunk_idx int, canonical string")
    forms = spark.createDataFrame([("java", "java", 0), ("db", "sql", 0), ("c", "c++", 0)], "skill string, form string, seq int")
    assert {(r.skill, r.chunk_idx, r.kind) for r in matching.literal(chunks, forms).collect()} == {("java", 1, "exact"), ("db", 1, "alias")}


def test_orphans_and_verdicts(spark):
    m = spark.createDataFrame([(1, "a", "SKILLS"), (1, "b", "SKILLS"), (1, "b", "PROJECTS")], "doc_id long, skill string, section string")
    s = judgement.support(m)
    assert {(r.skill, r.orphan) for r in s.collect()} == {("a", True), ("b", False)}
    cells = spark.createDataFrame([(1, x, 1.0) for x in "abcd"], "doc_id long, skill string, lex double")
    of = lambda *x: spark.createDataFrame([(y,) for y in x], "skill string")
    v = judgement.verdicts(cells, of("d").withColumn("doc_id", F.lit(1)), of("a", "b", "d"), spark.createDataFrame([(1, 2)], "doc_id long, n_repos int"), s)
    assert {r.skill: r.verdict for r in v.collect()} == {"a": "CONTRADICTED", "b": "UNVERIFIED", "c": "UNVERIFIABLE", "d": "CORROBORATED"}


def test_places_count_ties_by_id(spark):
    pool = spark.createDataFrame([(1, 50.0), (2, 60.0), (3, 60.0), (4, 70.0)], "doc_id long, score double")
    trials = spark.createDataFrame([(1, 60.0, "x"), (1, 70.0, "y"), (3, 80.0, "x"), (4, 70.0, "z")], "doc_id long, score double, skill string")
    assert {(r.doc_id, r.skill): r.new_rank for r in views.places(pool, trials).collect()} == {(1, "x"): 2, (1, "y"): 1, (3, "x"): 1, (4, "z"): 1}


def test_tree_with_a_cycle_ends(spark):
    skills = spark.createDataFrame([("s", "a", 3, None)], "skill string, parent string, difficulty int, also array<string>")
    concepts = spark.createDataFrame([("a", "b"), ("b", "a")], "concept string, parent string")
    assert {(r.ancestor, r.level) for r in taxonomy.closure(skills, concepts).collect()} == {("a", 0), ("b", 1)}


def test_dependencies_and_handles(spark):
    files = [("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}'), ("requirements.txt", "-r x\nFlask==2 # web\n\nnumpy"), ("README.md", "react")]
    got = spark.createDataFrame(files, "n string, b string").select("n", documents.dependencies(F.col("n"), F.col("b")).alias("d")).collect()
    assert {r.n: r.d for r in got} == {"package.json": ["jest", "react"], "requirements.txt": ["Flask", "numpy"], "README.md": []}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c01_ann.txt").write_text("Ann Lee\n" + "wrote services in several languages\n" * 20)
    (tmp_path / "in" / "c02_bad.pdf").write_bytes(b"%PDF-1.4 \xff\xfe")
    (tmp_path / "in" / "c03_none.txt").write_text("")
    rows = {r.doc_id: r for r in documents.read_texts(spark, str(tmp_path / "in")).collect()}
    assert rows["c01_ann"].quality > 0.4 and not rows["c01_ann"].warnings and rows["c02_bad"].quality == 0 and rows["c03_none"].warnings
    (tmp_path / "m.json").write_text('{"_note": "x",\n "js": "javascript"}')
    assert [tuple(r) for r in documents.read_map(spark, str(tmp_path / "m.json")).collect()] == [("js", "javascript")]
    (tmp_path / "p").mkdir()
    proof = {"skill_id": "go", "source": "github", "kind": "language", "where": "r", "detail": "d"}
    profile = {"source": "github", "handle": "ann", "status": "ok", "skills": {"go": [proof, proof]}, "repos": [{"name": "r", "stars": 2, "readme_skills": ["go", "aws"], "code_skills": ["go"]}]}
    (tmp_path / "p" / "ann.json").write_text(json.dumps(profile, indent=1))
    documents.write_cache(documents.read_profiles(spark, str(tmp_path / "p")), str(tmp_path / "cache"))
    cached = documents.read_cache(spark, str(tmp_path / "cache"))
    assert documents.proofs(cached).count() == 1 and documents.repositories(cached).first().readme_only == ["aws"] and documents.best_repository(documents.repositories(cached)).first().name == "r"
    nested = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "doc_id long, skill string, n int")
    told = {r.doc_id: json.loads(r.json) for r in documents.as_json(spark.createDataFrame([(1, 0.5), (2, 0.1)], "doc_id long, score double"), gaps=(nested, "n")).collect()}
    assert [g["skill"] for g in told[1]["gaps"]] == ["a", "b"] and told[2]["gaps"] == []


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.org • x"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    arrivals.prepared(arrivals.arriving(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(arrivals.prepared(docs))


def test_service(spark):
    d = "/root/testdata/sf0.001"
    s = Service()
    with pytest.raises(NoPool):
        s.rank()
    s.analyze(catalog.cells(spark, d), catalog.subs(spark, d))
    s.skills, s.concepts = judged.tree(spark, d)
    s.pins = spark.createDataFrame([("Brand#1", "Brand#2", 3.0)], "source string, target string, weeks double")
    assert s.health() == {"status": "ok", "pool": 10} and s.rank(blind=True).count() == 10
    intent, rows = s.chat("top 2")
    assert intent == "TOP_N" and rows.count() == 2
    assert s.chat("compare 1 and 2")[0] == "COMPARE" and s.chat("what is 3 missing")[1].count() == 1
    assert s.feedback().columns and s.relate("Brand#1", "Brand#2").first().weeks == 2.7 and s.taxonomy("Brand#1").count() <= 6


def test_no_task_has_more_text_than_its_share(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(200)] + [(200, None)], "i int, text string").coalesce(1)
    dealt = bounded(df, "text", 100)
    sizes = [sum(len(r.text or "") for r in p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 200 and sum(sizes) == 2000
    assert bounded(df.limit(0), "text").count() == 0


def test_redaction_searches_each_text_that_can_match():
    parts = ["12 Long Street", "Univerſity of Bonn", "COLLEGE", "ınstitute", "a@b.co.uk", "lınkedin.com/in/x", "LinkedIn.com/in/ab-c/", "GitHub.com/u/r", "gıthub.com/a@b.org", "GİTHUB.com/12345678", "UNIVERSITÄT", "vidyapeeth", "tea"]
    for t in [*parts, *(f"{a} {b}" for a in parts for b in parts)]:
        hits = [(m.start(), -m.end(), kind) for kind, pattern, _ in redaction._COMPILED for m in pattern.finditer(t)]
        shelter = [m.span() for m in redaction._CODE_URL.finditer(t)]
        want, done = [], 0
        for a, z, kind in sorted((h for h in hits if not any(h[0] < d and c < -h[1] for c, d in shelter)), key=lambda h: h[:2]):
            if a >= done:
                want, done = [*want, (kind, a, -z)], -z
        assert [(s["category"], s["start"], s["end"]) for s in redaction.redact_text(t)["spans"]] == want
