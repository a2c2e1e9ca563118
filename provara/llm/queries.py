"""The dealt operators as queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provara.llm import centroids, cws, exactdedup, langid, mixing, neardedup, packing, pieces, pii, quality, shared, substrings, toxicity, trie
from provara.session import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pii.personal_data(F.col("text")).alias("p"))
    counts = [F.expr(f"cast(size(filter(p.base, s -> s.kind = '{k}')) as long) as n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, "p.base_sha256", "p.spans", F.size("p.added").cast("long").alias("n_added"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.near_groups(table(spark, sf_dir, "documents")).drop(*shared.KEY)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade")))
    return quality.score_quality(docs, model).select("doc_id", "expected_grade", "tail_prob", "keep")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents")).drop(*shared.KEY)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document without doc_id is never learnt from
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = langid.fit_languages(docs.where("not held_out"))
    return langid.with_language(docs, model).select("doc_id", "held_out", "lang_pred", "score", "languages")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    each = shared.repeated(found, "n_rows")
    taken = F.col("size") * (F.col("copies") + (F.col("repeat") < F.col("extra")).cast("int"))
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))
    return toxicity.score_toxicity(docs, model).select("doc_id", "expected_severity", "tail_prob", "toxic")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = (F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language": op6_language,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_centroids": op11_centroids,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_prefix_trie": op13_prefix_trie,
}

#: One round: every vector's nearest centroid, and the floor of the means (sum - sum mod n) / n.
_ASSIGNED = """
a{i} AS (SELECT vec_id, v, arg_min(number, d * 16 + number) AS number, min(d) AS d FROM (
  SELECT vec_id, v, number, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM w, c{i}) GROUP BY vec_id, v)"""
_MOVED = """
m{i} AS (SELECT number, list(m ORDER BY place) AS c FROM (
  SELECT number, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM (SELECT number, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY number, place) GROUP BY number),
c{j} AS (SELECT c{i}.number, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (number)),"""

ORACLE_SQL: dict[str, str] = {
    "op11_centroids": """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS number, v AS c FROM w ORDER BY number LIMIT 16),"""
    + "".join(_ASSIGNED.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(3))
    + _ASSIGNED.format(i=3)
    + """
SELECT vec_id, number::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY number))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (number)
""",
    "op5_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
w AS (SELECT doc_id, bare, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER o AS place
      FROM t WINDOW o AS (PARTITION BY bare ORDER BY n_cp DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM w
""",
    # crc32 bit by bit over the id's decimal digits
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS g, length(text) AS n, turn FROM t),
own AS (SELECT conv_id, list({'g': g, 'n': n} ORDER BY turn NULLS FIRST, g) AS turns FROM g GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - (conv_id % 100 + 100) % 100 AS base, xor(list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(conv_id::VARCHAR, '.'), lambda x: ascii(x)::UBIGINT)),
    lambda c, x: list_reduce(list_concat([xor(c, x)], repeat([0::UBIGINT], 8)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 6 AS h FROM own),
r AS (SELECT h.conv_id AS c, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.base),
p AS (SELECT c, len(turns) AS len, d, sha256(array_to_string(list_transform(turns[1:d], lambda x: x.g), ',')) AS k,
  sha256(array_to_string(list_transform(turns[1:d - 1], lambda x: x.g), ',')) AS up, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS n
  FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
nodes AS (SELECT d, k, any_value(up) AS up, min(c) AS conv, count(*) AS n_convs, any_value(n) AS n,
  sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE d = len), '')) AS ends FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
sums AS (SELECT p.d, p.k, sum((n_convs - 1) * nodes.n) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
  FROM nodes LEFT JOIN kids USING (d, k) JOIN p ON p.c = nodes.conv AND p.d <= nodes.d GROUP BY p.d, p.k)
SELECT x.conv AS conv_id, x.d::BIGINT AS depth, y.conv AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN nodes y ON y.d = x.d - 1 AND y.k = x.up AND x.d > 0 LEFT JOIN kids ON kids.d = x.d AND kids.k = x.k JOIN sums ON sums.d = x.d AND sums.k = x.k
""",
}
