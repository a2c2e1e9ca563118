"""Taxonomy, judgement and view operators as queries over the pool of catalog.py, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provara.operators import fusion, judgement, taxonomy, views
from provara.plans import catalog, service
from provara.plans.catalog import BASE
from provara.plans.registry import query
from provara.session import table
from provara.sources import documents

# The concept tree: nations under regions, the first three regions under "world", all under "all"; two brands to a nation.


def _brands(spark: SparkSession, d: str) -> DataFrame:
    i = F.row_number().over(Window.orderBy("skill")) - 1
    return table(spark, d, "part").select(F.col("p_brand").alias("skill")).distinct().withColumn("i", i)


def tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = _brands(spark, d)
    beside = b.select(F.col("skill").alias("other"), F.col("i").alias("j"))
    skills = b.join(F.broadcast(beside), F.col("j") == (F.col("i") * 7 + 3) % 25, "left").select("skill", F.concat(F.lit("n"), F.floor(F.col("i") / 2).cast("string")).alias("parent"), (F.col("i") % 5 + 1).cast("int").alias("difficulty"), F.when(F.col("other").isNotNull(), F.array("other")).alias("also"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("concept"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("concept"), F.when(F.col("r_regionkey") < 3, "world").otherwise("all").alias("parent"))
    top = spark.createDataFrame([("world", "all"), ("all", None)], "concept string, parent string")
    return skills, n.unionByName(r).unionByName(top)


_TREE = """, sk AS (SELECT skill, i, (i // 2)::INT AS n, (i % 5 + 1)::INT AS difficulty FROM (SELECT skill, row_number() OVER (ORDER BY skill) - 1 AS i FROM skills)),
up AS (SELECT skill, 'n' || n AS ancestor, 0 AS level FROM sk UNION ALL SELECT skill, 'r' || n_regionkey, 1 FROM sk JOIN nation ON n = n_nationkey UNION ALL
  SELECT skill, CASE WHEN n_regionkey < 3 THEN 'world' ELSE 'all' END, 2 FROM sk JOIN nation ON n = n_nationkey UNION ALL SELECT skill, 'all', 3 FROM sk JOIN nation ON n = n_nationkey WHERE n_regionkey < 3),
cd AS (SELECT 'all' AS c, 0 AS depth UNION ALL SELECT 'world', 1 UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey < 3 THEN 2 ELSE 1 END FROM region UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_regionkey < 3 THEN 3 ELSE 2 END FROM nation),
pairs AS (SELECT a.skill AS a, b.skill AS b, l.common, coalesce(depth, -1)::INT AS shared_depth, CASE WHEN a.i = b.i THEN 0 ELSE coalesce(u + v + 2, 99) END::INT AS steps,
  CASE WHEN a.i = b.i THEN 'identical' WHEN l.common IS NULL THEN 'unrelated' WHEN b.i = (a.i * 7 + 3) % 25 OR a.i = (b.i * 7 + 3) % 25 THEN 'sibling' WHEN depth = 0 THEN 'discipline' WHEN u = 0 AND v = 0 THEN 'sibling' WHEN u <= 1 AND v <= 1 AND depth >= 2 THEN 'family' ELSE 'domain' END AS kind
  FROM sk a CROSS JOIN sk b LEFT JOIN (SELECT x.skill AS sa, y.skill AS sb, arg_min(x.ancestor, x.level) AS common, min(x.level) AS u, arg_min(y.level, x.level) AS v FROM up x JOIN up y USING (ancestor) GROUP BY 1, 2) l ON sa = a.skill AND sb = b.skill LEFT JOIN cd ON cd.c = l.common)"""


@query("X01_closure", BASE + _TREE + "SELECT skill, ancestor, level::INT AS level FROM up")
def _closure(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.closure(*tree(spark, d)).withColumn("level", F.col("level").cast("int"))


@query("X02_concept_depths", BASE + _TREE + "SELECT c AS concept, depth::BIGINT AS depth FROM cd")
def _depths(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.concept_depths(tree(spark, d)[1])


@query("X04_relations", BASE + _TREE + "SELECT a, b, kind, common, shared_depth, steps FROM pairs")
def _relations(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.relations(*tree(spark, d))


@query("X05_neighbours", BASE + _TREE + "SELECT a, b, place::INT AS place FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY steps, shared_depth DESC, b) AS place FROM pairs WHERE kind NOT IN ('identical', 'unrelated', 'discipline')) WHERE place <= 6")
def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.neighbours(taxonomy.relations(*tree(spark, d))).select("a", "b", "place")


_SCALE = "CASE difficulty WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 1.4::DOUBLE ELSE 1.9::DOUBLE END"
_BRIDGES = (
    _TREE
    + catalog._GAPS
    + f""", pins AS (SELECT a.skill AS source, b.skill AS target, 1 + (a.i % 7) / 2.0::DOUBLE AS pin FROM sk a JOIN sk b ON b.i = (a.i * 3 + 1) % 25 AND a.i <> b.i),
held AS (SELECT doc_id, skill AS source, CASE status WHEN 'MATCHED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.75::DOUBLE ELSE 0.4::DOUBLE END AS strength FROM cells WHERE status <> 'MISSING'),
walks AS (SELECT g.doc_id, g.skill, h.source, pin, round_even(greatest(coalesce(pin, CASE kind WHEN 'identical' THEN 0.0::DOUBLE WHEN 'sibling' THEN 1.0::DOUBLE WHEN 'family' THEN 1.5::DOUBLE WHEN 'domain' THEN 2.5::DOUBLE WHEN 'discipline' THEN 6.0::DOUBLE ELSE 9.0::DOUBLE END * {_SCALE}) * (1.25::DOUBLE - 0.35::DOUBLE * strength), 0.25), 1) AS weeks, kind
  FROM g JOIN sk ON sk.skill = g.skill JOIN held h ON h.doc_id = g.doc_id AND h.source <> g.skill JOIN pairs ON a = h.source AND b = g.skill LEFT JOIN pins p ON p.source = h.source AND p.target = g.skill WHERE g.place <= 5),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, skill ORDER BY pin IS NULL, weeks, source) AS r FROM walks),
br AS (SELECT g.doc_id, g.skill, source AS springboard, coalesce(CASE WHEN pin IS NULL THEN kind WHEN weeks <= 1.2 THEN 'sibling' WHEN weeks <= 2.0 THEN 'family' WHEN weeks <= 3.5 THEN 'domain' ELSE 'discipline' END, 'unrelated') AS kind,
  coalesce(weeks, round_even(9.0::DOUBLE * {_SCALE}, 1)) AS weeks, pin IS NOT NULL AS pinned FROM (SELECT * FROM g WHERE place <= 5) g JOIN sk ON sk.skill = g.skill LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.doc_id = g.doc_id AND b.skill = g.skill)"""
)
_HUMAN = "CASE WHEN weeks <= 0 THEN 'already there' WHEN weeks < 0.85 THEN 'a few days' WHEN weeks < 1.3 THEN '~1 week' WHEN weeks < 4.4 THEN floor(weeks)::INT || '-' || (floor(weeks)::INT + 1) || ' weeks' WHEN weeks / 4.345 < 1.3 THEN '~1 month' WHEN weeks / 4.345 < 2.0 THEN '6-8 weeks' ELSE floor(weeks / 4.345)::INT || '+ months' END"


def bridges(spark: SparkSession, d: str) -> DataFrame:
    skills, concepts = tree(spark, d)
    b = _brands(spark, d)
    other = b.select(F.col("skill").alias("target"), F.col("i").alias("j"))
    pins = b.join(other, (F.col("j") == (F.col("i") * 3 + 1) % 25) & (F.col("i") != F.col("j"))).select(F.col("skill").alias("source"), "target", (F.lit(1) + F.col("i") % 7 / 2.0).alias("weeks"))
    cells = catalog.cells(spark, d)
    held = cells.where("status <> 'MISSING'").select("doc_id", "skill", taxonomy._lookup(taxonomy.HELD, F.col("status"), 0.0).alias("strength"))
    return taxonomy.bridges(fusion.top_gaps(cells).select("doc_id", "skill"), held, taxonomy.relations(skills, concepts), skills, pins)


@query("X06_bridges", BASE + _BRIDGES + f"SELECT doc_id, skill, springboard, kind, weeks, pinned, {_HUMAN} AS human FROM br")
def _bridges(spark: SparkSession, d: str) -> DataFrame:
    return bridges(spark, d)


@query("U02_rampup_weeks", BASE + _BRIDGES + ", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weeks DESC, skill) - 1 AS i FROM br) SELECT doc_id, round_even(sum(weeks * pow(0.6::DOUBLE, i)), 1) AS weeks FROM o GROUP BY doc_id")
def _rampup(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.combined(bridges(spark, d))


_JUDGED = """, sk AS (SELECT skill, row_number() OVER (ORDER BY skill) - 1 AS i FROM skills),
mentions AS (SELECT l_suppkey AS doc_id, p_brand AS skill, (['INTERESTS', 'SKILLS', 'EXPERIENCE', 'EDUCATION'])[l_linenumber % 4 + 1] AS section FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 47),
sup0 AS (SELECT doc_id, skill, count(*) FILTER (section IN ('SKILLS', 'INTERESTS', 'SUMMARY')) AS inventory, count(*) FILTER (section IN ('EXPERIENCE', 'PROJECTS', 'ACHIEVEMENTS', 'CERTIFICATIONS')) AS evidence, count(*) AS hits FROM mentions GROUP BY 1, 2),
sup AS (SELECT doc_id, skill, inventory, evidence, hits - inventory - evidence AS other, (inventory > 0 AND inventory = hits) AS orphan FROM sup0),
proof AS (SELECT DISTINCT l_suppkey AS doc_id, p_brand AS skill FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 49),
ver AS (SELECT c.doc_id, c.skill, CASE WHEN p.skill IS NOT NULL THEN 'CORROBORATED' WHEN k.i % 4 = 0 THEN 'UNVERIFIABLE' WHEN s_nationkey % 4 < 2 THEN 'UNVERIFIED' WHEN orphan = FALSE THEN 'UNVERIFIED' ELSE 'CONTRADICTED' END AS verdict
  FROM cells c JOIN sk k ON k.skill = c.skill JOIN supplier ON s_suppkey = c.doc_id LEFT JOIN proof p ON p.doc_id = c.doc_id AND p.skill = c.skill LEFT JOIN sup ON sup.doc_id = c.doc_id AND sup.skill = c.skill WHERE lex > 0),
integ AS (SELECT *, (lists AND orphans >= 3 AND orphan_ratio >= 0.45) AS stuffing FROM (SELECT doc_id, count(*) AS named, count(*) FILTER (orphan) AS orphans, round_even(count(*) FILTER (orphan) / count(*), 3) AS orphan_ratio, bool_or(inventory > 0) AS lists FROM sup GROUP BY 1)),
tru AS (SELECT doc_id, corroborated, contradicted, unverifiable, unverified, CASE WHEN corroborated + contradicted > 0 THEN round_even(corroborated / (corroborated + contradicted), 3) ELSE 0.5 END AS trust FROM
  (SELECT doc_id, count(*) FILTER (verdict = 'CORROBORATED') AS corroborated, count(*) FILTER (verdict = 'CONTRADICTED') AS contradicted, count(*) FILTER (verdict = 'UNVERIFIABLE') AS unverifiable, count(*) FILTER (verdict = 'UNVERIFIED') AS unverified FROM ver GROUP BY 1))"""


def _support(spark: SparkSession, d: str) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, ("INTERESTS", "SKILLS", "EXPERIENCE", "EDUCATION"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    m = table(spark, d, "lineitem").where("l_quantity > 47").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return judgement.support(m.select(F.col("l_suppkey").alias("doc_id"), F.col("p_brand").alias("skill"), named.alias("section")))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    proof = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("doc_id"), F.col("p_brand").alias("skill"))
    repos = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_nationkey") % 4).alias("n_repos"))
    return judgement.verdicts(catalog.cells(spark, d), proof, _brands(spark, d).where("i % 4 <> 0"), repos, _support(spark, d))


@query("I03_support", BASE + _JUDGED + "SELECT doc_id, skill, inventory, evidence, other, orphan FROM sup")
def _sup(spark: SparkSession, d: str) -> DataFrame:
    return _support(spark, d).drop("sections")


@query("I04_integrity", BASE + _JUDGED + "SELECT doc_id, named, orphans, orphan_ratio, stuffing FROM integ")
def _integ(spark: SparkSession, d: str) -> DataFrame:
    return judgement.integrity(_support(spark, d))


@query("V02_verdicts", BASE + _JUDGED + "SELECT * FROM ver")
def _ver(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query("V03_trust", BASE + _JUDGED + "SELECT * FROM tru")
def _trust(spark: SparkSession, d: str) -> DataFrame:
    return judgement.trust(_verdicts(spark, d))


@query("V07_pool_summary", BASE + _JUDGED + "SELECT count(*) FILTER (stuffing) AS stuffing, coalesce(sum(orphans), 0)::BIGINT AS orphans, coalesce(sum(corroborated), 0)::BIGINT AS corroborated, coalesce(sum(contradicted), 0)::BIGINT AS contradicted FROM integ FULL JOIN tru USING (doc_id)")
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return judgement.pool_summary(judgement.integrity(_support(spark, d)), judgement.trust(_verdicts(spark, d)))


_ADJ = """, adj AS (SELECT doc_id, skill, coalesce(verdict, 'UNVERIFIED') AS verdict, CASE verdict WHEN 'CORROBORATED' THEN 1.35::DOUBLE WHEN 'CONTRADICTED' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS ext, CASE WHEN orphan THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END AS integ FROM ver FULL JOIN sup USING (doc_id, skill))"""


@query("A01_adjustments", BASE + _JUDGED + _ADJ + "SELECT * FROM adj")
def _adjustments(spark: SparkSession, d: str) -> DataFrame:
    return judgement.adjustments(_verdicts(spark, d), _support(spark, d))


@query("F08_adjusted_coverage", BASE + _JUDGED + _ADJ + """, x AS (SELECT c.doc_id, weight, tier, least(lex_eff * coalesce(integ, 1.0) * coalesce(ext, 1.0), 1.0) AS l, sem_cal FROM cells c LEFT JOIN adj USING (doc_id, skill))
SELECT doc_id, round(round(sum(weight * l) / sum(weight), 10), 6) AS lex_cov, round(round(sum(weight * greatest(l, sem_cal)) FILTER (tier = 'REQUIRED') / sum(weight) FILTER (tier = 'REQUIRED'), 10), 6) AS req_coverage FROM x GROUP BY doc_id""")  # fmt: skip
def _adjusted(spark: SparkSession, d: str) -> DataFrame:
    a = judgement.adjusted(catalog.cells(spark, d), judgement.adjustments(_verdicts(spark, d), _support(spark, d)))
    return fusion.rollups(a).select("doc_id", *(F.round(F.round(c, 10), 6).alias(c) for c in ("lex_cov", "req_coverage")))


@query("T11_hidden_spans", """SELECT p_partkey, CASE WHEN (0.299::DOUBLE * ((c >> 16) & 255) + 0.587::DOUBLE * ((c >> 8) & 255) + 0.114::DOUBLE * (c & 255)) / 255 >= 0.93 THEN 'colour' ELSE 'size' END AS reason FROM (SELECT *, (p_partkey * 7919 + 16000000) % 16777216 AS c FROM part)
WHERE length(trim(p_name)) >= 12 AND ((0.299::DOUBLE * ((c >> 16) & 255) + 0.587::DOUBLE * ((c >> 8) & 255) + 0.114::DOUBLE * (c & 255)) / 255 >= 0.93 OR p_size < 4)""")  # fmt: skip
def _hidden(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_size").alias("size"), ((F.col("p_partkey") * 7919 + 16000000) % 16777216).alias("color"))
    return judgement.hidden(s).select("p_partkey", "reason")


@query("H01_explained", BASE + """, e AS (SELECT doc_id, skill, row_number() OVER (PARTITION BY doc_id ORDER BY sem_raw DESC, skill) AS r FROM cells WHERE sem_raw > 0)
SELECT doc_id, count(*) FILTER (tier = 'REQUIRED' AND status IN ('MATCHED', 'INFERRED')) AS met, count(*) FILTER (tier = 'REQUIRED' AND status = 'MISSING') AS missing, coalesce((SELECT string_agg(skill, ', ' ORDER BY r) FROM e WHERE e.doc_id = cells.doc_id AND r <= 3), '') AS best FROM cells GROUP BY doc_id""")  # fmt: skip
def _explained(spark: SparkSession, d: str) -> DataFrame:
    return views.explained(catalog.cells(spark, d))


@query("W03_roadmap", BASE + catalog._GAPS + """, tw AS (SELECT doc_id, sum(weight) AS w FROM cells GROUP BY doc_id),
t AS (SELECT g.doc_id, g.skill, g.tier, r.rank, r.score AS was, round_even(50.0::DOUBLE * (round(r.k + 0.6::DOUBLE * g.weight * (1 - g.lex_eff) / tw.w, 9) + r.m), 2) AS score FROM g JOIN tw USING (doc_id) JOIN ranked r ON r.doc_id = g.doc_id WHERE g.place <= 5),
u AS (SELECT doc_id, skill, tier, rank - 1 - (SELECT count(*) FROM ranked o WHERE o.doc_id <> t.doc_id AND (o.score > t.score OR (o.score = t.score AND o.doc_id < t.doc_id))) AS places, round(score - was, 2) AS points FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY places DESC, points DESC, tier <> 'REQUIRED', skill) AS step FROM u) SELECT doc_id, skill, step::INT AS step, places, points FROM v WHERE step <= 3 AND (places > 0 OR points > 0)""")  # fmt: skip
def _roadmap(spark: SparkSession, d: str) -> DataFrame:
    return views.roadmap(catalog.cells(spark, d), catalog.prims(spark, d))


@query("W05_rejected", BASE + "SELECT doc_id, rank, score, round((SELECT score FROM ranked WHERE rank = 5) - score, 2) AS short FROM ranked WHERE rank > 5 AND rank <= 25")
def _rejected(spark: SparkSession, d: str) -> DataFrame:
    return views.rejected(fusion.ranked(catalog.prims(spark, d)), 5, 20)


@query("G07_missing", BASE + "SELECT doc_id, coalesce(string_agg(skill, ', ' ORDER BY skill) FILTER (status = 'MISSING' AND tier = 'REQUIRED'), '') AS missing, coalesce(string_agg(skill, ', ' ORDER BY skill) FILTER (status = 'WEAK'), '') AS weak, coalesce(string_agg(skill, ', ' ORDER BY skill) FILTER (status = 'INFERRED'), '') AS inferred, round(round(100 * coalesce(sum(weight * coverage) FILTER (tier = 'REQUIRED') / sum(weight) FILTER (tier = 'REQUIRED'), 0.0), 10), 4) AS covered FROM cells GROUP BY doc_id")
def _missing(spark: SparkSession, d: str) -> DataFrame:
    return views.missing(catalog.cells(spark, d))


@query("G08_who_has", BASE + "SELECT doc_id, status, rank FROM cells JOIN ranked USING (doc_id) WHERE skill = 'Brand#11' AND status IN ('MATCHED', 'INFERRED')")
def _who(spark: SparkSession, d: str) -> DataFrame:
    return views.who_has(catalog.cells(spark, d), fusion.ranked(catalog.prims(spark, d)), "Brand#11")


@query("G09_top_asked", r"SELECT conv_id, turn, least(greatest(CASE WHEN n = '' THEN 3 ELSE n::INT END, 1), 100)::INT AS n FROM (SELECT conv_id, turn, coalesce(regexp_extract(lower(text), '\btop\s*(\d{1,9})', 1), '') AS n FROM conversations)")
def _top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", views.top_asked(F.coalesce("text", F.lit("")), F.lit(100)).alias("n"))


@query("Q03_questions", BASE + _JUDGED + """, q AS (SELECT c.*, CASE WHEN status IN ('MISSING', 'WEAK') AND tier = 'REQUIRED' AND (i % 5 + 1 >= 3 OR verdict = 'CONTRADICTED') THEN 'GAP' WHEN verdict = 'CONTRADICTED' THEN 'CLAIM' WHEN status = 'INFERRED' THEN 'INFERRED' END AS kind FROM cells c JOIN sk USING (skill) LEFT JOIN ver USING (doc_id, skill)),
o AS (SELECT *, CASE kind WHEN 'GAP' THEN 0 WHEN 'CLAIM' THEN 1 ELSE 2 END AS branch, row_number() OVER (PARTITION BY doc_id, kind ORDER BY weight DESC, round(coverage, 6), skill) AS own FROM q WHERE kind IS NOT NULL),
p2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY branch, own) AS place FROM o WHERE own <= CASE WHEN kind = 'INFERRED' THEN 1 ELSE 2 END) SELECT doc_id, place::INT AS place, kind, skill FROM p2 WHERE place <= 3""")  # fmt: skip
def _questions(spark: SparkSession, d: str) -> DataFrame:
    hard = _brands(spark, d).select("skill", (F.col("i") % 5 + 1).alias("difficulty"))
    return views.questions(catalog.cells(spark, d), _verdicts(spark, d), hard)


@query("B06_inclusivity", "SELECT user_id AS doc_id, greatest(0, 100 - sum(CASE event_type WHEN 'error' THEN 30 WHEN 'signup' THEN 12 WHEN 'purchase' THEN 6 ELSE 2 END))::BIGINT AS score FROM events GROUP BY 1")
def _inclusivity(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "error", "critical").when(e == "signup", "high").when(e == "purchase", "medium").otherwise("other")
    return views.inclusivity(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), kind.alias("severity")))


_HANDLE = "(?i)(?:https?://)?(?:www\\.)?github\\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)"


@query("E01_handles", f"""SELECT o_orderkey, list_filter(regexp_extract_all(t, '{_HANDLE}', 1), lambda h: NOT (lower(h) IN ('topics', 'about')))[1] AS github, nullif(regexp_extract(t, '(?i)linkedin\\.com/in/([A-Za-z0-9%-]{{3,100}})', 1), '') AS linkedin
FROM (SELECT o_orderkey, (['see github.com/topics and https://GitHub.com/u' || o_custkey || '-x/repo', 'www.linkedin.com/in/p-' || o_custkey || '/', 'github.com/About', 'none'])[o_orderkey % 4 + 1] AS t FROM orders)""")  # fmt: skip
def _handles(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    told = F.array(F.concat(F.lit("see github.com/topics and https://GitHub.com/u"), c, F.lit("-x/repo")), F.concat(F.lit("www.linkedin.com/in/p-"), c, F.lit("/")), F.lit("github.com/About"), F.lit("none"))
    h = table(spark, d, "orders").select("o_orderkey", documents.handles(F.element_at(told, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("h"))
    return h.select("o_orderkey", "h.github", "h.linkedin")


@query("E05_main_languages", """WITH b AS (SELECT o_custkey AS handle, o_orderstatus AS name, o_orderpriority AS language, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 1, 2, 3)
SELECT handle, name, language FROM (SELECT *, sum(bytes) OVER (PARTITION BY handle, name) AS total FROM b) WHERE bytes >= 0.05::DOUBLE * total""")  # fmt: skip
def _languages(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("handle"), F.col("o_orderstatus").alias("name"), "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("bytes"))
    return documents.main_languages(b.groupBy("handle", "name").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "bytes"))).alias("languages")))


@query("F16_without_skills", BASE + "SELECT doc_id, round(round(sum(weight * lex_eff) / sum(weight), 10), 6) AS lex_cov FROM cells WHERE skill NOT IN ('Brand#11', 'Brand#12') GROUP BY doc_id")
def _without(spark: SparkSession, d: str) -> DataFrame:
    left = catalog.cells(spark, d).join(F.broadcast(spark.createDataFrame([("Brand#11",), ("Brand#12",)], "skill string")), "skill", "left_anti")
    return fusion.rollups(left).select("doc_id", F.round(F.round("lex_cov", 10), 6).alias("lex_cov"))


@query("F21_moves_by_alpha", BASE + """, o AS (SELECT doc_id, row_number() OVER (ORDER BY round_even(100.0::DOUBLE * (0.8::DOUBLE * k + (1 - 0.8::DOUBLE) * m), 2) DESC, doc_id) AS then_rank FROM p)
SELECT doc_id, rank, then_rank, rank - then_rank AS moved FROM ranked JOIN o USING (doc_id)""")  # fmt: skip
def _moves(spark: SparkSession, d: str) -> DataFrame:
    return service.moved(catalog.prims(spark, d), 0.5, 0.8)
