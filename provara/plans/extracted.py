"""Chunks, sections, requirements, the semantic channel, wording and repositories as queries, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provara.functions.numeric import rounded
from provara.operators import bias, enrichment, fusion, judgement, requirements, sections, semantic, tellings, text
from provara.plans import catalog
from provara.plans.registry import query
from provara.plans.texts import _LINES, ALIASES
from provara.session import settled, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("T05_chunks", rf"""WITH {_LINES}, s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS begins FROM l),
c AS (SELECT doc_id, line_no, begins, CASE WHEN length({_BARE.format("line")}) > {text.LONG_LINE} THEN string_split(regexp_replace(line, '([.!?])(\s+[A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) ELSE [line] END AS parts
  FROM s WHERE length({_BARE.format("line")}) >= {text.LEAST_CHUNK}),
p AS (SELECT doc_id, line_no, begins, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM c),
q AS (SELECT *, begins + sum(length(part)) OVER (PARTITION BY doc_id, line_no ORDER BY k) - length(part) + length(part) - length(regexp_replace(part, '^\s+', '')) AS start, {_BARE.format("part")} AS text FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_idx, start::INT AS start, (start + length(text))::INT AS "end", text FROM q WHERE length(text) >= {text.LEAST_CHUNK}""")  # fmt: skip
def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.chunks(_docs(spark, d))


#: Texts with headers, told by events, twelve lines to a text.
_HEADED = """hl AS (SELECT event_id // 12 AS doc_id, event_id % 12 AS line_no, (['Work Experience:', 'built ' || event_type || ' pipelines for years', 'EDUCATON', 'a degree in something', 'Technical Skils', 'Certificatons:', '  Projects', 'Unrelated Words', 'internships', 'Tech-stack'])[(event_id * 7 + user_id) % 10 + 1] AS line FROM events)"""


def headed(spark: SparkSession, d: str) -> DataFrame:
    """Texts with headers as above: doc_id and text."""
    e = F.col("event_type")
    lines = F.array(F.lit("Work Experience:"), F.concat(F.lit("built "), e, F.lit(" pipelines for years")), *map(F.lit, ("EDUCATON", "a degree in something", "Technical Skils", "Certificatons:", "  Projects", "Unrelated Words", "internships", "Tech-stack")))
    line = F.element_at(lines, ((F.col("event_id") * 7 + F.col("user_id")) % 10 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 12).alias("doc_id"), "event_id", line.alias("line"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id").agg(texts.alias("text"))


# the names that these headers come near, told by hand
_NAMES = "(VALUES ('Work Experience:', 'EXPERIENCE'), ('EDUCATON', 'EDUCATION'), ('Technical Skils', 'SKILLS'), ('Certificatons:', 'CERTIFICATIONS'), ('  Projects', 'PROJECTS'), ('internships', 'EXPERIENCE'), ('Tech-stack', 'SKILLS')) AS n(line, name)"


@query("T07_sections", f"""WITH {_HEADED}, s AS (SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS begins, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS size FROM hl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
h AS (SELECT doc_id, name, begins, begins + length(line) AS header_end, coalesce(lead(begins) OVER (PARTITION BY doc_id ORDER BY begins), size) AS until FROM s JOIN {_NAMES} USING (line)),
g AS (SELECT doc_id, name, min(begins) AS first, arg_min(header_end, begins) AS start, max(until) AS until FROM h GROUP BY 1, 2)
SELECT doc_id, name, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS seq, start::INT AS start, until::INT AS "end" FROM g""")  # fmt: skip
def _sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.sections(headed(spark, d))


@query("T07_section_headers")
def _headers(spark: SparkSession, d: str) -> DataFrame:
    return sections.sections(_docs(spark, d))


@query("T13_line_at", r"""SELECT doc_id, regexp_replace(list_last(string_split(substr(t, 1, p::INT), chr(10))) || string_split(substr(t, p::INT + 1), chr(10))[1], '^\s+|\s+$', '', 'g') AS line
FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) // 2 AS p FROM documents)""")  # fmt: skip
def _line_at(spark: SparkSession, d: str) -> DataFrame:
    middle = F.floor(F.length("text") / 2).cast("int")
    return _docs(spark, d).select("doc_id", bias.line_at(F.col("text"), middle).alias("line"))


@query("T15_title", "SELECT doc_id, string_split(coalesce(text, ''), chr(10))[2] AS title FROM documents")
def _title(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.get(F.split("text", "\n"), F.lit(1)).alias("title"))


_FOLD = r"regexp_replace(lower(line), '\b(de la|der|und|de|la)\b', chr(1) || '\1' || chr(1), 'g')"
for _k, _v in ALIASES.items():
    _FOLD = f"replace({_FOLD}, chr(1) || '{_k}' || chr(1), '{_v}')"
_GAZETTEER = r"gz AS (SELECT item_id AS skill, regexp_extract(text, '[A-Za-z]+', 0) AS label, list_slice(regexp_extract_all(text, '[A-Za-z]+'), 2, 3) AS aliases FROM benchmark)"


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """skill, label and aliases: the first words of benchmark items."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("skill"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("label"), F.slice(words, 2, 2).alias("aliases"))


def canonical_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("canonical", text.folded(F.col("line"), ALIASES))


@query("J06_surface_forms", f"WITH {_GAZETTEER}, f AS (SELECT skill::VARCHAR AS skill, list_concat([skill::VARCHAR, lower(label)], list_transform(aliases, lambda a: lower(a))) AS f FROM gz) SELECT DISTINCT skill, unnest(f) AS form FROM f")
def _forms(spark: SparkSession, d: str) -> DataFrame:
    return requirements.forms_of(gazetteer(spark, d)).select("skill", "form")


@query("J02_gazetteer_scan", f"""WITH {_LINES}, {_GAZETTEER}, f AS (SELECT DISTINCT skill::VARCHAR AS skill, unnest(list_concat([skill::VARCHAR, lower(label)], list_transform(aliases, lambda a: lower(a)))) AS form FROM gz),
t AS (SELECT doc_id, line_no, unnest(list_distinct(list_concat(regexp_split_to_array(lower(line), '[^a-zA-Z0-9]+'), regexp_split_to_array({_FOLD}, '[^a-zA-Z0-9]+')))) AS form FROM l)
SELECT DISTINCT doc_id, skill, line_no FROM t JOIN f USING (form) WHERE form <> ''""")  # fmt: skip
def _scan(spark: SparkSession, d: str) -> DataFrame:
    return requirements.scanned(canonical_lines(spark, d), requirements.forms_of(gazetteer(spark, d)))


_NEVER = ", ".join(f"'{w}'" for w in dict.fromkeys(requirements.NEVER_MINED))


@query("J04_mined_terms", rf"""WITH {_LINES}, m AS (SELECT doc_id, line_no, regexp_extract_all(regexp_replace(line, '[À-ÿ]', '_', 'g'), '{requirements.CAPITALS}', 1) AS found FROM l),
t AS (SELECT doc_id, line_no, unnest(found) AS label, generate_subscripts(found, 1) AS place FROM m),
k AS (SELECT *, lower(label) AS skill FROM t WHERE len(list_intersect(string_split(label, ' '), [{_NEVER}])) = 0 AND length(label) >= 3 AND (regexp_matches(label, '[0-9+#.]') OR NOT contains(label, ' ')))
SELECT doc_id, skill, arg_min(label, line_no * 100000 + place) AS label, min(line_no) AS line_no FROM k GROUP BY 1, 2""")  # fmt: skip
def _mined(spark: SparkSession, d: str) -> DataFrame:
    lines = canonical_lines(spark, d).withColumn("tier", F.lit("REQUIRED"))
    none = spark.createDataFrame([], "skill string, form string")
    return requirements.mined_terms(lines, none).select("doc_id", "skill", "label", "line_no")


@query("J05_order", catalog.BASE + "SELECT skill, row_number() OVER (ORDER BY tier <> 'REQUIRED', lower(skill), skill) AS place FROM skills")
def _order(spark: SparkSession, d: str) -> DataFrame:
    return fusion.placed(catalog.skills(spark, d), "place", F.col("tier") != "REQUIRED", F.lower("skill"), F.col("skill")).select("skill", "place")


_TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_TFIDF = rf"""chunk AS (SELECT doc_id AS key, {_TERMS} AS w FROM documents), phrase AS (SELECT item_id AS key, {_TERMS} AS w FROM benchmark),
ct AS (SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM chunk), pt AS (SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM phrase),
ctf AS (SELECT key, term, count(*) AS n FROM ct GROUP BY 1, 2), ptf AS (SELECT key, term, count(*) AS n FROM pt GROUP BY 1, 2),
idf AS (SELECT term, ln(((SELECT count(*) FROM chunk) + 1) / (count(*) + 1)) + 1 AS idf FROM ctf GROUP BY term),
cw AS (SELECT key, term, (ln(n) + 1) * idf AS w FROM ctf JOIN idf USING (term)), pw AS (SELECT key, term, (ln(n) + 1) * idf AS w FROM ptf JOIN idf USING (term)),
cn AS (SELECT key, sqrt(sum(w * w)) AS size FROM cw GROUP BY key), pn AS (SELECT key, sqrt(sum(w * w)) AS size FROM pw GROUP BY key),
cos AS (SELECT c.key AS doc_id, p.key AS skill, sum(c.w * p.w) / (any_value(cn.size) * any_value(pn.size)) AS sim FROM cw c JOIN pw p USING (term) JOIN cn ON c.key = cn.key JOIN pn ON p.key = pn.key GROUP BY 1, 2)"""


def _term_sims(spark: SparkSession, d: str) -> DataFrame:
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("skill"), "text")
    return semantic.text_cosines(_docs(spark, d).withColumnRenamed("doc_id", "key"), phrases)


@query("M02_tfidf_cosine", f"WITH {_TFIDF} SELECT doc_id, skill, round(sim, 6) AS sim FROM cos")
def _tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _term_sims(spark, d).select(F.col("key").alias("doc_id"), "skill", F.round("sim", 6).alias("sim"))


@query("M02_latent_channel")
def _latent(spark: SparkSession, d: str) -> DataFrame:
    """Best chunk of each document and phrase, and the document's nearness to all phrases in one, in 32 latent dimensions."""
    phrases = table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = phrases.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    kinds = {
        "chunk": text.chunks(_docs(spark, d)).select(F.struct("doc_id", "chunk_idx", F.lit(None).cast("long").alias("skill")).alias("key"), "text"),
        "phrase": phrases.select(F.struct(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.col("item_id").cast("long").alias("skill")).alias("key"), "text"),
        "asked": asked.select(F.struct(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.lit(-1).cast("long").alias("skill")).alias("key"), "text"),
    }
    vectors = semantic.reduced(kinds["chunk"].unionByName(kinds["phrase"]).unionByName(kinds["asked"]), 32, steps=3).select("key.*", "vector")
    chunks = vectors.where("skill is null").select("doc_id", "chunk_idx", "vector")
    said = settled(vectors.where("skill is not null").select("skill", F.col("vector").alias("phrase")))
    best = semantic.nearest(chunks, said.where("skill >= 0"), said.where("skill = -1"))
    return best.select("doc_id", "skill", F.round("sem_raw", 4).alias("sem_raw"), "chunk_idx", F.round("docsim_raw", 4).alias("docsim_raw"))


#: Vectors are chunks of 50 documents; a label's centroid is its skill's phrase.
_DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
_VECTORS = f"""v AS (SELECT vec_id % 50 AS doc_id, vec_id AS chunk_idx, label, embedding::DOUBLE[] AS e FROM embeddings),
ex AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), mean AS (SELECT label, i, avg(x) AS x FROM ex GROUP BY 1, 2),
ph AS (SELECT label AS skill, list(x ORDER BY i) AS q FROM mean GROUP BY label),
sims AS (SELECT doc_id, chunk_idx, label, skill, round(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 6) AS sim FROM v CROSS JOIN ph),
best AS (SELECT doc_id, skill, max(sim) AS sem_raw, arg_min(chunk_idx, (-sim, chunk_idx)) AS near FROM sims GROUP BY 1, 2),
lit AS (SELECT doc_id, label AS skill, min(chunk_idx) AS lit FROM v GROUP BY 1, 2),
cite AS (SELECT doc_id, skill, CASE WHEN lit IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS lex, sem_raw, coalesce(lit, near) AS cite FROM best LEFT JOIN lit USING (doc_id, skill))"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("doc_id"), F.col("vec_id").alias("chunk_idx"), "label", F.col("embedding").alias("vector"))
    each = e.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    phrase = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return e, each.groupBy(F.col("label").alias("skill")).agg(phrase.alias("phrase"))


def _sims(spark: SparkSession, d: str) -> DataFrame:
    return semantic.cosines(*_vectors(spark, d)).withColumn("sim", F.round("sim", 6))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    e, _ = _vectors(spark, d)
    literal = e.groupBy("doc_id", F.col("label").alias("skill")).agg(F.min("chunk_idx").alias("chunk_idx"), F.lit(1.0).alias("lex"))
    return semantic.cited(literal, semantic.best_chunks(_sims(spark, d)))


@query("M04_all_cosines", f"WITH {_VECTORS} SELECT doc_id, chunk_idx, skill, sim FROM sims")
def _cosines(spark: SparkSession, d: str) -> DataFrame:
    return _sims(spark, d)


@query("M05_best_chunks", f"WITH {_VECTORS} SELECT doc_id, skill, sem_raw, near AS chunk_idx FROM best")
def _best(spark: SparkSession, d: str) -> DataFrame:
    return semantic.best_chunks(_sims(spark, d))


@query("M07_citations", f"WITH {_VECTORS} SELECT doc_id, skill, lex, sem_raw, cite FROM cite")
def _cite(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d)


@query("K05_context", f"""WITH {_VECTORS}, cx AS (SELECT doc_id, chunk_idx, CASE WHEN chunk_idx % 2 = 0 THEN 'SKILLS' ELSE 'PROJECTS' END AS section, round(1 - (chunk_idx % 5) / 10.0::DOUBLE, 2) AS weight FROM v WHERE chunk_idx % 3 > 0)
SELECT doc_id, skill, cite, CASE WHEN lex > 0 THEN coalesce(section, 'UNKNOWN') ELSE 'UNKNOWN' END AS section, CASE WHEN lex > 0 THEN coalesce(weight, 1.0) ELSE 1.0 END AS context_weight
FROM cite LEFT JOIN cx ON cite.doc_id = cx.doc_id AND cite.cite = cx.chunk_idx""".replace("SELECT doc_id, skill, cite,", "SELECT cite.doc_id, skill, cite,"))  # fmt: skip
def _context(spark: SparkSession, d: str) -> DataFrame:
    e, _ = _vectors(spark, d)
    i = F.col("chunk_idx")
    context = e.where(i % 3 > 0).select("doc_id", "chunk_idx", F.when(i % 2 == 0, "SKILLS").otherwise("PROJECTS").alias("section"), F.round(1 - (i % 5) / 10.0, 2).alias("weight"))
    return semantic.with_context(_cited(spark, d), context).select("doc_id", "skill", "cite", "section", "context_weight")


@query("M08_sub_scores", f"""WITH {_VECTORS}, docs AS (SELECT unnest(range(0, 60)) AS doc_id), j AS (SELECT doc_id, round(avg(sim), 6) AS docsim_raw FROM (SELECT doc_id, sim, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, chunk_idx) AS p FROM sims WHERE skill = 0) WHERE p <= 3 GROUP BY doc_id),
b AS (SELECT doc_id, count(*)::DOUBLE AS bm25_raw FROM v GROUP BY doc_id)
SELECT doc_id, skill, coalesce(lex, 0.0) AS lex, coalesce(sem_raw, 0.0) AS sem_raw, coalesce(bm25_raw, 0.0) AS bm25_raw, coalesce(docsim_raw, 0.0) AS docsim_raw, coalesce(cite, -1) AS cite
FROM docs CROSS JOIN (SELECT skill FROM ph) LEFT JOIN cite USING (doc_id, skill) LEFT JOIN b USING (doc_id) LEFT JOIN j USING (doc_id)""")  # fmt: skip
def _sub_scores(spark: SparkSession, d: str) -> DataFrame:
    e, phrases = _vectors(spark, d)
    docsim = semantic.docsim(_sims(spark, d).where("skill = 0")).withColumn("docsim_raw", F.round("docsim_raw", 6))
    bm25 = e.groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    docs = spark.range(60).select(F.col("id").alias("doc_id"))
    return semantic.sub_scores(docs, phrases, _cited(spark, d), bm25, docsim)


_VERDICT = "CASE (doc_id + length(skill)) % 3 WHEN 0 THEN 'CORROBORATED' WHEN 1 THEN 'CONTRADICTED' ELSE 'UNVERIFIED' END"


@query("F07_claim_counts", catalog.BASE + f"SELECT doc_id, count(*) FILTER ({_VERDICT} = 'CORROBORATED') AS n_proven, count(*) FILTER ({_VERDICT} = 'CONTRADICTED') AS n_contradicted FROM cells GROUP BY doc_id")
def _claim_counts(spark: SparkSession, d: str) -> DataFrame:
    told = catalog.cells(spark, d).withColumn("verdict", F.expr(_VERDICT))
    return fusion.rollups(told).select("doc_id", "n_proven", "n_contradicted")


_HIDDEN = """hid AS (SELECT event_id % 400 AS doc_id, event_id AS seq, event_type || ' ' || props AS text, CASE WHEN value > 50 THEN 'colour' ELSE 'size' END AS reason FROM events WHERE event_type = 'error')"""


def _hidden(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    reason = F.when(F.col("value") > 50, "colour").otherwise("size")
    return e.select((F.col("event_id") % 400).alias("doc_id"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "props").alias("text"), reason.alias("reason"))


@query("I05_hidden_report", catalog.BASE + f", {_HIDDEN}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place FROM hid), s AS (SELECT doc_id, string_agg(substr(text, 1, 90) || ' (' || reason || ')', '|' ORDER BY seq) AS samples FROM n WHERE place <= 3 GROUP BY doc_id) SELECT doc_id, samples IS NOT NULL AS hidden_flag, coalesce(samples, '') AS samples, CASE WHEN samples IS NOT NULL THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS doc_multiplier FROM pool LEFT JOIN s USING (doc_id)")
def _hidden_report(spark: SparkSession, d: str) -> DataFrame:
    r = judgement.hidden_report(catalog.pool(spark, d), _hidden(spark, d))
    return r.select("doc_id", "hidden_flag", F.array_join("hidden_samples", "|").alias("samples"), "doc_multiplier")


@query("F11_document_multiplier", catalog.BASE + f", {_HIDDEN} SELECT doc_id, round_even(100.0::DOUBLE * (0.25 * k + 0.75 * m) * (0.60::DOUBLE + 0.40::DOUBLE * req_coverage) * CASE WHEN doc_id IN (SELECT doc_id FROM hid) THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END, 2) AS score FROM p")
def _multiplied(spark: SparkSession, d: str) -> DataFrame:
    r = judgement.hidden_report(catalog.pool(spark, d), _hidden(spark, d)).select("doc_id", "doc_multiplier")
    return fusion.scored(catalog.prims(spark, d).join(r, "doc_id"), 0.25, True).select("doc_id", "score")


@query("F16_without_two", catalog.BASE + """, rest AS (SELECT * FROM cells WHERE skill NOT IN (SELECT skill FROM skills ORDER BY skill LIMIT 2)),
r2 AS (SELECT doc_id, sum(weight * lex_eff) / sum(weight) AS l, sum(weight * sem_cal) / sum(weight) AS s FROM rest GROUP BY doc_id)
SELECT doc_id, round(0.40::DOUBLE * nb + (1 - 0.40::DOUBLE) * l, 6) AS k, round(0.25::DOUBLE * nd + (1 - 0.25::DOUBLE) * s, 6) AS m FROM r2 JOIN normed USING (doc_id)""")  # fmt: skip
def _without(spark: SparkSession, d: str) -> DataFrame:
    drop = catalog.skills(spark, d).orderBy("skill").limit(2)
    out = fusion.without(catalog.cells(spark, d), catalog.prims(spark, d), drop)
    return out.select("doc_id", F.round("k", 6).alias("k"), F.round("m", 6).alias("m"))


@query("F17_cells_by_status", catalog.BASE + "SELECT doc_id, skill, (row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, round(coverage, 6) DESC, lower(skill)))::INT AS place FROM cells WHERE status IN ('INFERRED', 'WEAK')")
def _by_status(spark: SparkSession, d: str) -> DataFrame:
    return fusion.by_status(catalog.cells(spark, d), "INFERRED", "WEAK").select("doc_id", "skill", "place")


@query("F18_changed_worth", catalog.BASE + "SELECT doc_id, skill, lex > 0 AND lex_eff < lex - 1e-9 AS discounted, lex_eff > lex + 1e-9 AS boosted FROM cells")
def _changed(spark: SparkSession, d: str) -> DataFrame:
    return catalog.cells(spark, d).select("doc_id", "skill", fusion.discounted().alias("discounted"), fusion.boosted().alias("boosted"))


@query("F19_rescored", catalog.BASE + "SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round_even(100.0::DOUBLE * (0.75 * k + 0.25 * m) * (0.60::DOUBLE + 0.40::DOUBLE * req_coverage), 2) AS score FROM p)")
def _rescored(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(catalog.prims(spark, d), 0.75, True).select("doc_id", "score", "rank")


#: A small lexicon over the invented prose; operators take any.
LEXICON = (
    {"category": "a", "severity": "high", "pattern": r"\bder\b", "suggestion": "the"},
    {"category": "a", "severity": "low", "pattern": r"\bd[a-z]{2}\b", "suggestion": "x"},
    {"category": "b", "severity": "medium", "pattern": r"\bund\b", "suggestion": "and"},
)


@query("B01_lexicon_scan")
def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return bias.lexicon_findings(_docs(spark, d), LEXICON)


#: Job texts told by events; the pool's months are quantities of line items.
_JOBS = "jobs AS (SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'Internship. ' ELSE 'Senior role. ' END || 'needs ' || (event_id % 7) || CASE WHEN event_id % 3 = 0 THEN '+' ELSE '' END || ' years of experience' AS text FROM events)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Job texts as above: doc_id and text."""
    e = F.col("event_id")
    opening = F.when(e % 2 == 0, "Internship. ").otherwise("Senior role. ")
    job = F.concat(opening, F.lit("needs "), (e % 7).cast("string"), F.when(e % 3 == 0, "+").otherwise(""), F.lit(" years of experience"))
    return table(spark, d, "events").select(e.alias("doc_id"), job.alias("text"))


@query("B03_seniority", f"""WITH {_JOBS}, y AS (SELECT doc_id, text, regexp_extract(text, '([0-9]+)\\+?\\s*years?(?:\\s+of)?\\s+experience') AS matched FROM jobs WHERE contains(lower(text), 'intern')),
z AS (SELECT *, regexp_extract(matched, '^[0-9]+')::BIGINT AS years FROM y WHERE matched <> ''), h AS (SELECT l_quantity::INT AS months, count(*) AS n FROM lineitem GROUP BY 1)
SELECT doc_id, strpos(text, matched)::INT - 1 AS start, matched, years, coalesce((SELECT sum(n) FROM h WHERE months < years * 12), 0)::BIGINT AS impact_count FROM z WHERE years >= 2""")  # fmt: skip
def _seniority(spark: SparkSession, d: str) -> DataFrame:
    months = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("months"))
    return bias.seniority(jobs(spark, d), months, ("intern",)).select("doc_id", "start", "matched", "years", "impact_count")


@query("B05_one_for_each_span")
def _one_span(spark: SparkSession, d: str) -> DataFrame:
    return bias.one_for_each_span(bias.lexicon_findings(_docs(spark, d), LEXICON).withColumn("impact_count", F.lit(0).cast("long")))


#: Pages as files of repositories: the host is the repository, what follows the path.
_PATHS = "pt AS (SELECT split_part(url, '/', 3) AS repo, page_id AS seq, substr(url, length(split_part(url, '/', 1)) + length(split_part(url, '/', 3)) + 4) AS path FROM pages)"
_NEEDLES = "nd AS (SELECT n_nationkey AS seq, (['page', 'index.html', 'post', '1', '7'])[n_nationkey % 5 + 1] AS needle, n_name AS skill FROM nation)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("repo"), F.col("page_id").alias("seq"), F.expr("substr(url, length(split_part(url, '/', 1)) + length(split_part(url, '/', 3)) + 4)").alias("path"))


@query("E06_proving_files", f"""WITH {_PATHS}, {_NEEDLES}, m AS (SELECT DISTINCT repo, path, seq, skill FROM (SELECT DISTINCT repo, path FROM pt) JOIN nd ON list_last(string_split(lower(path), '/')) = needle OR contains(lower(path), needle))
SELECT repo, path, arg_min(skill, seq) AS skill FROM m GROUP BY 1, 2""")  # fmt: skip
def _files(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    needle = F.element_at(F.array(*map(F.lit, ("page", "index.html", "post", "1", "7"))), (n % 5 + 1).cast("int"))
    needles = table(spark, d, "nation").select(n.alias("seq"), needle.alias("needle"), F.col("n_name").alias("skill"))
    return enrichment.proving_files(_paths(spark, d), needles)


@query("E07_manifests", f"WITH {_PATHS}, w AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY seq) AS place FROM pt WHERE len(string_split(path, '/')) - 1 <= 2 AND list_last(string_split(path, '/')) IN (SELECT list_last(string_split(path, '/')) FROM pt WHERE seq % 3 = 0)) SELECT repo, path, place::INT AS place FROM w WHERE place <= 4")
def _manifests(spark: SparkSession, d: str) -> DataFrame:
    paths = _paths(spark, d)
    names = paths.where("seq % 3 = 0").select(enrichment.base_name(F.col("path")).alias("name"))
    return enrichment.manifests(paths, names)


@query("E04_dependency_skills", "SELECT event_id, n_name AS skill FROM events JOIN nation ON lower(trim(' ' || upper(event_type) || (event_id % 30) || ' ')) = 'click' || n_nationkey")
def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat(F.lit(" "), F.upper("event_type"), (F.col("event_id") % 30).cast("string"), F.lit(" "))
    deps = table(spark, d, "events").select("event_id", named.alias("dep"))
    known = table(spark, d, "nation").select(F.concat(F.lit("Click"), "n_nationkey").alias("key"), F.col("n_name").alias("skill"))
    return enrichment.looked_up(deps, "dep", known).select("event_id", "skill")


@query("E09_readme_claims", f"WITH {_GAZETTEER}, t AS (SELECT page_id AS repo, unnest(list_distinct(regexp_split_to_array(lower(html), '[^a-z0-9]+'))) AS form FROM pages) SELECT DISTINCT repo, skill::VARCHAR AS skill FROM t JOIN gz ON form = lower(label) WHERE form <> ''")
def _readmes(spark: SparkSession, d: str) -> DataFrame:
    known = gazetteer(spark, d).select("skill", F.col("label").alias("key"))
    return enrichment.readme_claims(table(spark, d, "pages").select(F.col("page_id").alias("repo"), F.col("html").alias("text")), known)


@query("E12_combined_proofs", "SELECT user_id AS doc_id, event_type AS skill, count(*) AS n, CASE WHEN count(*) FILTER (value > 50) > 0 THEN 1.35::DOUBLE ELSE 1.08::DOUBLE END AS multiplier FROM events GROUP BY 1, 2")
def _combined(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("skill"), F.when(F.col("value") > 50, "github").otherwise("linkedin").alias("source"))
    return enrichment.combined(e)


@query("V01_detectable", "SELECT p_brand AS skill FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region")
def _detectable(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return enrichment.detectable(part.select(F.col("p_brand").alias("skill")), part.select(F.col("p_type").alias("skill")), table(spark, d, "nation").select(F.col("n_name").alias("skill")), table(spark, d, "region").select(F.col("r_name").alias("skill")))


_CHANNEL = """CASE flag WHEN 'HIDDEN_GEM' THEN base || '. Flagged HIDDEN GEM: required skills are demonstrably practised but not stated in the job description''s vocabulary, so a keyword-only filter would rank this candidate ' || abs(rank_k - rank_m) || CASE WHEN abs(rank_k - rank_m) = 1 THEN ' place' ELSE ' places' END || ' lower than the evidence warrants.'
WHEN 'SURFACE_MATCH' THEN base || '. Flagged SURFACE MATCH: the resume names the required skills but shows little supporting work, so lexical coverage runs well ahead of semantic coverage. Worth probing in interview.' ELSE base || '. Both channels agree (lexical #' || rank_k || ', semantic #' || rank_m || ').' END"""


@query("H02_channel_lines", catalog.BASE + f"SELECT doc_id, {_CHANNEL} AS line FROM (SELECT *, printf('Keyword channel %.2f, semantic channel %.2f', round(k, 2), round(m, 2)) AS base FROM ranked)")
def _channel_lines(spark: SparkSession, d: str) -> DataFrame:
    r = fusion.ranked(catalog.prims(spark, d)).withColumns({c: rounded(F.col(c), 2) for c in ("k", "m")})
    return r.select("doc_id", tellings.channel_line().alias("line"))


#: Weeks of each document: ten times what its five gaps lack, in their weights.
@query("U03_ramp_up_verdicts", catalog.BASE + catalog._GAPS + """, s AS (SELECT doc_id, round(sum(weight * (1 - coverage)), 2) AS weeks, list(skill ORDER BY place) AS a, list(skill ORDER BY place) FILTER (tier = 'REQUIRED') AS r FROM g WHERE place <= 5 GROUP BY doc_id),
t AS (SELECT pool.doc_id, coalesce(weeks, 0.0) AS weeks, a, CASE WHEN len(coalesce(r, [])) > 0 THEN r ELSE a END AS shown, len(coalesce(r, [])) > 0 AS asked FROM pool LEFT JOIN s USING (doc_id))
SELECT doc_id, CASE WHEN a IS NULL THEN 'ready' WHEN weeks <= 2 THEN 'short' WHEN weeks <= 6 THEN 'moderate' ELSE 'long' END AS verdict, len(coalesce(shown, []))::INT AS n FROM t""")  # fmt: skip
def _ramp_verdicts(spark: SparkSession, d: str) -> DataFrame:
    gaps = fusion.top_gaps(catalog.cells(spark, d))
    sums = gaps.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * (1 - F.col("coverage"))), 2).alias("weeks"))
    weeks = catalog.pool(spark, d).join(sums, "doc_id", "left").select("doc_id", F.coalesce("weeks", F.lit(0.0)).alias("weeks"), F.lit("some weeks").alias("human"))
    told = tellings.ramp_up(gaps, weeks)
    n = F.coalesce(F.regexp_extract("headline", r"^(\d+) ", 1).try_cast("int"), F.lit(0))
    return told.select("doc_id", "verdict", n.alias("n"))


@query("X08_reasons", "SELECT n_name AS target, CASE n_nationkey % 5 WHEN 0 THEN 'Both are ' || r_name || '; the concepts carry over and the syntax is the delta.' WHEN 1 THEN 'Same family (' || r_name || ') — the model transfers, the API surface does not.' WHEN 2 THEN 'Shared ground is ' || r_name || '; the ecosystem around it is new.' WHEN 3 THEN 'x and ' || n_name || ' only meet at ' || r_name || ' — this is a change of discipline, not a change of tool.' ELSE 'No adjacent experience on the resume.' END AS reason FROM nation JOIN region ON n_regionkey = r_regionkey")
def _reasons(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.element_at(F.array(*map(F.lit, ("sibling", "family", "domain", "discipline", "none"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return n.select(F.col("n_name").alias("target"), tellings.relation_reason(kind, F.col("r_name"), F.lit("x"), F.col("n_name")).alias("reason"))


@query("Q01_probes", catalog.BASE + "SELECT doc_id, skill, CASE WHEN skill LIKE '%1' THEN 'of ' || skill WHEN cluster = 0 THEN 'of the first' ELSE 'of others' END AS probe FROM cells")
def _probes(spark: SparkSession, d: str) -> DataFrame:
    own = catalog.skills(spark, d).where("skill like '%1'").select("skill", F.concat(F.lit("of "), "skill").alias("probe"))
    shared_ = spark.createDataFrame([(0, "of the first")], "cluster int, probe string")
    return tellings.probes(catalog.cells(spark, d), own, shared_, "of others").select("doc_id", "skill", "probe")


@query("H05_decisive", catalog.BASE + "SELECT skill, a.h AS in_a, b.h AS in_b, (row_number() OVER (ORDER BY weight DESC, skill))::INT AS place FROM (SELECT skill, weight, status IN ('MATCHED', 'INFERRED') AS h FROM cells WHERE doc_id = 1) a JOIN (SELECT skill, status IN ('MATCHED', 'INFERRED') AS h FROM cells WHERE doc_id = 2) b USING (skill) WHERE a.h <> b.h")
def _decisive(spark: SparkSession, d: str) -> DataFrame:
    return tellings.decisive(catalog.cells(spark, d), 1, 2)


@query("W04_combined_steps", catalog.BASE + catalog._GAPS + """, t AS (SELECT c.doc_id, sum(weight * CASE WHEN x.skill IS NOT NULL THEN 1.0 ELSE lex_eff END) / sum(weight) AS after, count(x.skill) AS n_steps FROM cells c LEFT JOIN (SELECT doc_id, skill FROM g WHERE place <= 3) x ON c.doc_id = x.doc_id AND c.skill = x.skill GROUP BY 1)
SELECT doc_id, n_steps, round(50.0::DOUBLE * 0.6 * (after - lex_cov), 4) AS points FROM t JOIN p USING (doc_id) WHERE n_steps > 0""")  # fmt: skip
def _combined_steps(spark: SparkSession, d: str) -> DataFrame:
    cells = catalog.cells(spark, d)
    return tellings.combined_steps(fusion.top_gaps(cells, 3), cells, catalog.prims(spark, d))


@query("H11_scatter", catalog.BASE + "SELECT doc_id, round(score / greatest(100.0, (SELECT max(score) FROM sc)), 6) AS x, round(least(greatest(1 - req_coverage, 0.0), 1.0), 6) AS y FROM sc")
def _scatter(spark: SparkSession, d: str) -> DataFrame:
    s = fusion.scored(catalog.prims(spark, d)).withColumn("gap_density", 1 - F.col("req_coverage"))
    return tellings.scatter(s).select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
