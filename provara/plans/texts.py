"""Text, redaction, dating and requirement operators as queries over documents, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provara.operators import claims, matching, redaction, requirements, text
from provara.plans.registry import query
from provara.session import spread, table

#: Folds of the query below; operators take any table of them.
ALIASES = {"de la": "del", "de": "of", "la": "the", "der": "the", "und": "and"}
_QUOTED = "'" + "', '".join(claims.MONTHS) + "'"
_HORIZON = str(claims.FALLBACK_STAMP)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INT AS line_no FROM documents)"


@query("T01_repair")
def _repair(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.repaired(F.col("text")).alias("text"))


_FOLD = "regexp_replace(lower(coalesce(text, '')), '\\b(de la|der|und|de|la)\\b', chr(1) || '\\1' || chr(1), 'g')"
for _k, _v in ALIASES.items():
    _FOLD = f"replace({_FOLD}, chr(1) || '{_k}' || chr(1), '{_v}')"


@query("T03_fold_aliases", f"SELECT doc_id, {_FOLD} AS folded FROM documents")
def _fold(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.folded(F.col("text"), ALIASES).alias("folded"))


@query("T12_trim", r"SELECT doc_id, CASE WHEN length(t) <= 150 THEN t ELSE rtrim(substr(t, 1, 149)) || '…' END AS shown FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)")
def _trim(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.trimmed(F.col("text")).alias("shown"))


@query("T14_listed", """WITH s AS (SELECT lang, list(DISTINCT source ORDER BY source) AS x FROM documents WHERE source IS NOT NULL GROUP BY lang)
SELECT lang, CASE WHEN len(x) > 3 THEN array_to_string(x[1:3], ', ') || ' and ' || (len(x) - 3) || ' more' WHEN len(x) <= 1 THEN array_to_string(x, '') ELSE array_to_string(x[1:len(x) - 1], ', ') || ' and ' || x[len(x)] END AS said FROM s""")  # fmt: skip
def _listed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("source is not null").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("x"))
    return s.select("lang", text.listed(F.col("x"), limit=3).alias("said"))


@query("T16_around", "SELECT doc_id, CASE WHEN length(text) >= 12 THEN substr(text, 1, 4) END AS before, CASE WHEN length(text) >= 12 THEN substr(text, 5, 8) END AS inside, CASE WHEN length(text) >= 12 THEN length(substr(text, 13)) END AS rest FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def _around(spark: SparkSession, d: str) -> DataFrame:
    a = _docs(spark, d).select("doc_id", text.around(F.col("text"), F.lit(4), F.lit(12)).alias("a"))
    return a.select("doc_id", "a.before", "a.inside", F.length("a.after").cast("long").alias("rest"))


@query("T10_display_name")
def _name(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.display_name(F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("_doc")), F.col("text")).alias("name"))


_SOLID = r"length(regexp_replace(t, '\s', '', 'g'))"
_RATIO = rf"CASE WHEN {_SOLID} = 0 THEN 0.0 ELSE length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) / {_SOLID} END"


@query("S03_usable", rf"SELECT doc_id, (length(trim(regexp_replace(t, '^\s+|\s+$', '', 'g'))) >= 200 AND {_RATIO} >= 0.5) AS usable FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _usable(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.usable(F.col("text")).alias("usable"))


@query("T09_parse_quality", rf"""SELECT doc_id, CASE WHEN length(s) = 0 THEN 0.0 ELSE round_even((0.40::DOUBLE * least(length(s) / 1200.0::DOUBLE, 1.0) + 0.20::DOUBLE * least(n / 4.0::DOUBLE, 1.0) + 0.20::DOUBLE * least(n / 15.0::DOUBLE, 1.0) + 0.20::DOUBLE * ({_RATIO})), 3) END AS quality
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)""")  # fmt: skip
def _quality(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.split("text", "\n"))
    return _docs(spark, d).select("doc_id", text.parse_quality(F.col("text"), n, n, F.lit(False)).alias("quality"))


@query("T08_sections", """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, source FROM documents), s AS (SELECT doc_id, 0 AS seq, 'SUMMARY' AS name, 0 AS a, n // 3 AS b FROM d UNION ALL SELECT doc_id, 1, 'SKILLS', n // 4, n // 2 FROM d UNION ALL SELECT doc_id, 2, 'PROJECTS', n // 2 + 10, n FROM d),
c AS (SELECT doc_id, unnest(range(0, n, 100)) AS start FROM d) SELECT doc_id, start::INT AS start, coalesce((SELECT min_by(name, seq) FROM s WHERE s.doc_id = c.doc_id AND a <= c.start AND c.start < b), 'UNKNOWN') AS section FROM c""")  # fmt: skip
def _sections(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    parts = [(0, "SUMMARY", F.lit(0), n.cast("long") / 3), (1, "SKILLS", n / 4, n / 2), (2, "PROJECTS", F.floor(n / 2) + 10, n)]
    docs = _docs(spark, d)
    s = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(x).alias("name"), F.floor(a).cast("int").alias("start"), F.floor(b).cast("int").alias("end")) for i, x, a, b in parts))).alias("s")).select("doc_id", "s.*")
    c = docs.where(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0), n - 1, F.lit(100))).alias("start"))
    return text.in_section(c, s)


@query("R02_redact")
def _redact(spark: SparkSession, d: str) -> DataFrame:
    r = _docs(spark, d).select("doc_id", redaction.redacted(F.col("text")).alias("r"))
    return r.select("doc_id", "r.text", F.size("r.spans").cast("long").alias("n_spans"), redaction.audit(F.col("r.spans")).alias("audit"))


@query("R07_mask_display")
def _mask(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", redaction.masked(F.col("text")).alias("text"))


@query("R08_aliases", "SELECT s_suppkey AS doc_id, printf('Candidate %02d', row_number() OVER (ORDER BY s_suppkey)) AS alias FROM supplier")
def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return redaction.aliases(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id")), "doc_id")


def _found(p: str, g: int, of: str = "lower(coalesce(text, ''))") -> str:
    return f"regexp_extract_all({of}, '{p}', {g})"


#: Dated lines: events told as text, since the invented prose of documents holds hardly any dates.
_TOLD = f"""told AS (SELECT event_id, user_id, event_type AS section, CASE event_id % 4 WHEN 0 THEN 'Led a team, ' || (['Jan', 'Feb', 'Mar', 'April', 'jun', 'Sept.'])[event_id % 6 + 1] || ' ' || (1990 + event_id % 36) || ' - ' || (['Nov', 'Dec', 'Aug'])[event_id % 3 + 1] || ' ' || (1991 + event_id % 36)
  WHEN 1 THEN 'Tools: ' || event_type || ', ' || (user_id % 97) || '; a b c, d | e' WHEN 2 THEN 'Built in ' || (1975 + event_id % 80) || ' to ' || (2000 + user_id % 60) || CASE WHEN event_id % 5 = 0 THEN ', now May 2024 to present' ELSE '' END ELSE (event_id % 13) || '/' || (2010 + event_id % 15) || ' - ' || (user_id % 12 + 1) || '/2024 none' END AS text FROM events)"""


def told(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    kind = e % 4
    line = (
        F.when(kind == 0, F.concat(F.lit("Led a team, "), pick(("Jan", "Feb", "Mar", "April", "jun", "Sept."), e % 6), F.lit(" "), (e % 36 + 1990).cast("string"), F.lit(" - "), pick(("Nov", "Dec", "Aug"), e % 3), F.lit(" "), (e % 36 + 1991).cast("string")))
        .when(kind == 1, F.concat(F.lit("Tools: "), "event_type", F.lit(", "), (u % 97).cast("string"), F.lit("; a b c, d | e")))
        .when(kind == 2, F.concat(F.lit("Built in "), (e % 80 + 1975).cast("string"), F.lit(" to "), (u % 60 + 2000).cast("string"), F.when(e % 5 == 0, ", now May 2024 to present").otherwise("")))
        .otherwise(F.concat((e % 13).cast("string"), F.lit("/"), (e % 15 + 2010).cast("string"), F.lit(" - "), (u % 12 + 1).cast("string"), F.lit("/2024 none")))
    )
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("section"), line.alias("text"))


_MONTH = f"list_position([{_QUOTED}], {{}}[1:3])"
_STAMPS = f"""stamped AS (SELECT *, CASE WHEN len({_found(claims.MONTH_YEAR, 2)}) > 0 THEN list_transform(list_zip({_found(claims.MONTH_YEAR, 1)}, {_found(claims.MONTH_YEAR, 2)}), lambda p: p[2]::INT * 12 + {_MONTH.format("p[1]")}) ELSE list_transform({_found(claims.YEAR, 1)}, lambda y: y::INT * 12 + 6) END AS stamps FROM told),
hor AS (SELECT user_id, max(list_max(stamps)) AS h FROM stamped GROUP BY user_id),
own AS (SELECT *, CASE WHEN regexp_matches(lower(text), '{claims.PRESENT}') THEN coalesce(h, {_HORIZON}) ELSE list_max(stamps) END AS own, coalesce(h, {_HORIZON}) AS horizon FROM stamped JOIN hor USING (user_id))"""


@query("C01_stamps", f"WITH {_TOLD}, {_STAMPS} SELECT event_id, len(stamps)::INT AS n, list_max(stamps)::INT AS latest, list_sum(stamps)::BIGINT AS total FROM stamped")
def _stamps(spark: SparkSession, d: str) -> DataFrame:
    s = told(spark, d).select("event_id", claims.stamps(F.col("text")).alias("s"))
    return s.select("event_id", F.size("s").alias("n"), F.array_max("s").alias("latest"), F.when(F.size("s") > 0, F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


_BARE = r"(len(list_filter(regexp_extract_all(lower(text), '[a-z][a-z+#.]*'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in claims.WORK_VERBS) + r"))) = 0 AND len(items) >= 4 AND len(list_filter(items, lambda i: len(regexp_split_to_array(i, '\s+')) > 3)) = 0)"
_ITEMS = "list_filter(list_transform(regexp_split_to_array(CASE WHEN contains(text[1:32], ':') THEN substr(text, instr(text, ':') + 1) ELSE text END, '[,;|/•·]+'), lambda i: trim(i)), lambda i: i <> '')"


@query("C04_bare_lists", f"WITH {_TOLD} SELECT event_id, {_BARE} AS bare FROM (SELECT *, {_ITEMS} AS items FROM told)")
def _bare(spark: SparkSession, d: str) -> DataFrame:
    return told(spark, d).select("event_id", claims.bare_list(F.col("text")).alias("bare"))


_SECTION = "(['EXPERIENCE', 'SKILLS', 'EDUCATION', 'OTHER'])[event_id % 4 + 1]"


@query("C07_claim_worth", f"""WITH {_TOLD}, {_STAMPS}, runs AS (SELECT *, event_id // 7 AS part FROM own), moved AS (SELECT *, CASE WHEN part IS NOT DISTINCT FROM lag(part) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS m FROM runs),
r AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM moved), c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stamp, {_ITEMS} AS items FROM r)
SELECT event_id, stamp::INT AS stamp, (own IS NULL AND stamp IS NOT NULL) AS inherited, round_even(CASE {_SECTION} WHEN 'EXPERIENCE' THEN 1.0::DOUBLE WHEN 'SKILLS' THEN 0.55::DOUBLE WHEN 'EDUCATION' THEN 0.60::DOUBLE ELSE 0.75::DOUBLE END
  * CASE WHEN stamp IS NULL OR greatest(horizon - stamp, 0) <= 12 THEN 1.0::DOUBLE ELSE 0.55::DOUBLE + 0.45::DOUBLE * pow(0.5::DOUBLE, (greatest(horizon - stamp, 0) - 12) / 30.0::DOUBLE) END * CASE WHEN {_BARE} THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END, 4) AS worth FROM c""")  # fmt: skip
def _worth(spark: SparkSession, d: str) -> DataFrame:
    t = told(spark, d)
    horizons = t.select("user_id", F.array_max(claims.stamps(F.col("text"))).alias("h")).groupBy("user_id").agg(F.coalesce(F.max("h"), F.lit(claims.FALLBACK_STAMP)).alias("horizon"))
    named = F.element_at(F.array(*map(F.lit, ("EXPERIENCE", "SKILLS", "EDUCATION", "OTHER"))), (F.col("event_id") % 4 + 1).cast("int"))
    c = t.join(horizons, "user_id").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("chunk_idx"), F.floor(F.col("event_id") / 7).alias("section"), "text", "horizon")
    c = claims.dated(c).withColumn("named", F.element_at(F.array(*map(F.lit, ("EXPERIENCE", "SKILLS", "EDUCATION", "OTHER"))), (F.col("chunk_idx") % 4 + 1).cast("int")))
    return c.select(F.col("chunk_idx").alias("event_id"), "stamp", "inherited", claims.worth(F.col("named"), F.col("stamp"), F.col("horizon"), claims.bare_list(F.col("text"))).alias("worth"))


def _zipped(p: str, n: int) -> str:
    return "list_zip(" + ", ".join(_found(p, i) for i in range(1, n + 1)) + ")"


@query("B02_experience_months", f"""WITH {_TOLD}, m AS (SELECT event_id, list_concat(list_concat(
  list_transform(list_filter({_zipped(claims.RANGES[0], 4)}, lambda g: {_MONTH.format("g[1]")} IS NOT NULL AND {_MONTH.format("g[3]")} IS NOT NULL), lambda g: (g[4]::INT - g[2]::INT) * 12 + {_MONTH.format("g[3]")} - {_MONTH.format("g[1]")}),
  list_transform(list_filter({_zipped(claims.RANGES[1], 2)}, lambda g: {_MONTH.format("g[1]")} IS NOT NULL), lambda g: {claims.PRESENT_STAMP} - g[2]::INT * 12 - {_MONTH.format("g[1]")})),
  list_transform({_zipped(claims.RANGES[2], 4)}, lambda g: (g[4]::INT - g[2]::INT) * 12 + g[3]::INT - g[1]::INT)) AS x FROM told)
SELECT event_id, coalesce(list_sum(list_filter(x, lambda v: v > 0 AND v <= {claims.LONGEST})), 0)::INT AS months FROM m""")  # fmt: skip
def _months(spark: SparkSession, d: str) -> DataFrame:
    return told(spark, d).select("event_id", claims.experience_months(F.col("text")).alias("months"))


_TIERS = f"""k AS (SELECT doc_id, line_no, trim(line) AS p, CASE WHEN length(trim(line)) >= 60 THEN NULL WHEN regexp_matches(lower(trim(line)), '{requirements.PREFERRED_HEADER}') THEN 'PREFERRED' WHEN regexp_matches(lower(trim(line)), '{requirements.REQUIRED_HEADER}') THEN 'REQUIRED' WHEN regexp_matches(lower(trim(line)), '{requirements.OTHER_HEADER}') THEN 'NONE' END AS head FROM l),
b AS (SELECT *, nullif(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'NONE') AS block FROM k),
tiers AS (SELECT doc_id, line_no, CASE WHEN p = '' THEN block WHEN head IS NOT NULL THEN NULL WHEN regexp_matches(lower(p), '{requirements.INLINE_PREFERRED}') THEN 'PREFERRED' WHEN regexp_matches(lower(p), '{requirements.INLINE_REQUIRED}') THEN 'REQUIRED' ELSE block END AS tier FROM b)"""

#: Requirement lines told by events, 12 to a document.
_ASKED = """l AS (SELECT event_id // 12 AS doc_id, (event_id % 12)::INT AS line_no, (['Required skills', event_type, 'Nice to have', event_type || ' would be great', 'About us', '', event_type || ' is required', 'Requirements:', 'proven ' || event_type, 'Bonus points', 'x ' || event_type])[(event_id * 7 + user_id) % 11 + 1] AS line, event_type AS skill FROM events)"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    lines = F.array(F.lit("Required skills"), e, F.lit("Nice to have"), F.concat(e, F.lit(" would be great")), F.lit("About us"), F.lit(""), F.concat(e, F.lit(" is required")), F.lit("Requirements:"), F.concat(F.lit("proven "), e), F.lit("Bonus points"), F.concat(F.lit("x "), e))
    at = ((F.col("event_id") * 7 + F.col("user_id")) % 11 + 1).cast("int")
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 12).alias("doc_id"), (F.col("event_id") % 12).cast("int").alias("line_no"), F.element_at(lines, at).alias("line"), e.alias("skill"))


@query("J01_line_tiers", f"WITH {_ASKED}, {_TIERS} SELECT * FROM tiers")
def _tiers(spark: SparkSession, d: str) -> DataFrame:
    return requirements.line_tiers(asked(spark, d)).select("doc_id", "line_no", "tier")


@query("J03_skill_tiers", f"""WITH {_ASKED}, {_TIERS}, m AS (SELECT l.doc_id, l.skill, l.line_no, tier FROM l JOIN tiers USING (doc_id, line_no) WHERE contains(line, skill)),
f AS (SELECT doc_id, skill, min(line_no) AS first_line, arg_min(coalesce(tier, 'REQUIRED'), line_no) AS first_tier, min(line_no) FILTER (tier = 'REQUIRED') AS asked_line FROM m GROUP BY 1, 2)
SELECT doc_id, skill, CASE WHEN asked_line IS NOT NULL THEN 'REQUIRED' ELSE first_tier END AS tier, CASE WHEN first_tier = 'PREFERRED' AND asked_line IS NOT NULL THEN asked_line ELSE first_line END AS line_no FROM f""")  # fmt: skip
def _skill_tiers(spark: SparkSession, d: str) -> DataFrame:
    found = requirements.line_tiers(asked(spark, d)).where(F.contains("line", "skill"))
    return requirements.skill_tiers(found).select("doc_id", "skill", "tier", "line_no")


_FORMS = "forms AS (SELECT item_id::BIGINT AS skill, lower(regexp_extract(text, '[A-Za-z]+', 0)) AS form FROM benchmark WHERE length(regexp_extract(text, '[A-Za-z]+', 0)) > 1)"


def forms(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("skill"), F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("form"), F.lit(0).alias("seq"))
    return b.where(F.length("form") > 1)


@query("K02_literal_match", f"""WITH {_LINES}, {_FORMS}, t AS (SELECT doc_id, line_no, unnest(list_distinct(regexp_split_to_array(lower(line), '[^a-z0-9]+'))) AS form FROM l)
SELECT doc_id, skill, min(line_no) AS chunk_idx, 'alias' AS kind FROM t JOIN forms USING (form) GROUP BY doc_id, skill""")  # fmt: skip
def _literal(spark: SparkSession, d: str) -> DataFrame:
    chunks = _lines(spark, d).select("doc_id", F.col("line_no").alias("chunk_idx"), F.lower("line").alias("canonical"))
    return matching.literal(chunks, forms(spark, d)).select("doc_id", "skill", "chunk_idx", "kind")


#: Similarity by the table of the longest common subsequence, for pairs whose edit distance does not rule them out.
_NEAR_FORMS = r"""w AS (SELECT doc_id, line_no, line, list_filter(list_transform(list_filter(regexp_extract_all(lower(line), '[a-z0-9][a-z0-9+#.\-]*'), lambda t: t NOT IN ({stop})), lambda t: regexp_replace(t, '[.\-]+$', '')), lambda t: length(t) > 1) AS t FROM l),
terms AS (SELECT doc_id, line_no, unnest(x) AS term, generate_subscripts(x, 1) - 1 AS place FROM (SELECT doc_id, line_no, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS x FROM w)),
pairs AS (SELECT term, form FROM (SELECT DISTINCT term FROM terms) JOIN (SELECT DISTINCT form FROM forms) ON abs(length(term) - length(form)) <= floor(0.12::DOUBLE * (length(term) + length(form)) + 1e-9)
  AND levenshtein(term, form) <= floor(0.12::DOUBLE * (length(term) + length(form)) + 1e-9)),
near AS (SELECT term, form, round(200.0::DOUBLE * list_last(list_reduce(list_transform(range(1, length(term) + 1), lambda i: [i]), lambda last, i: list_reduce(list_transform(range(1, length(form) + 1), lambda j: [j]),
    lambda done, j: list_append(done, CASE WHEN substr(form, j[1], 1) = substr(term, i[1], 1) THEN last[j[1]] + 1 ELSE greatest(done[j[1]], last[j[1] + 1]) END), [0::BIGINT]), list_transform(range(length(form) + 1), lambda z: 0::BIGINT)))
  / (length(term) + length(form)), 6) AS similarity FROM pairs)"""


@query("K04_fuzzy_terms", f"""WITH {_LINES}, {_FORMS}, {_NEAR_FORMS.format(stop=", ".join(f"'{w}'" for w in text.STOPWORDS))},
lit AS (SELECT DISTINCT doc_id, skill FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(line), '[^a-z0-9]+'))) AS form FROM l) JOIN forms USING (form)),
h AS (SELECT doc_id, skill, line_no, form, term, similarity, place FROM terms JOIN near USING (term) JOIN forms USING (form) WHERE similarity >= 88 AND (doc_id, skill) NOT IN (SELECT (doc_id, skill) FROM lit)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, skill ORDER BY line_no, form, similarity DESC, place, term) AS p FROM h)
SELECT doc_id, skill, line_no AS chunk_idx, form, term, similarity FROM o WHERE p = 1""")  # fmt: skip
def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    chunks = _lines(spark, d).select("doc_id", F.col("line_no").alias("chunk_idx"), F.lower("line").alias("canonical"), text.tokens(F.col("line")).alias("tokens"))
    return matching.near_hits(chunks, forms(spark, d))
