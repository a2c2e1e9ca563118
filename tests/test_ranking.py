"""The ranking model: properties of the score, and queries against DuckDB."""

import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from provara.functions.numeric import half_even, rounded
from provara.operators import fusion, text, views
from provara.plans import catalog, extracted

SF = "/root/testdata/sf0.001"


def test_alpha_ends_are_single_channels(spark):
    p = spark.createDataFrame([(1, 0.2, 0.9, 0.5), (2, 0.7, 0.1, 1.0)], "doc_id long, k double, m double, req_coverage double")
    assert [r.score for r in fusion.scored(p, 1.0).collect()] == [20.0, 70.0]
    assert [r.score for r in fusion.scored(p, 0.0).collect()] == [90.0, 10.0]
    assert [r.score for r in fusion.scored(p, 5.0).collect()] == [20.0, 70.0]


def test_equal_pool_norms_to_half(spark):
    p = spark.createDataFrame([(1, 3.0), (2, 3.0)], "doc_id long, x double")
    assert {r.norm_x for r in fusion.robust_norm(p, "x").collect()} == {0.5}


def test_line_spans_index_their_text(spark):
    docs = spark.createDataFrame([(1, "short\na line that is long enough to stay\né another line that is long enough")], "doc_id long, text string")
    for r in text.lines(docs).collect():
        assert docs.first().text[r.start : r.end] == r.line


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["F05_rollups", "F12_ranked", "B04_leave_one_out", "K01_bm25", "T05_lines"])
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), c.sql(catalog.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert a[cols].sort_values(cols).astype(str).values.tolist() == b[cols].sort_values(cols).astype(str).values.tolist()


def test_halves_of_the_pool_are_rounded_as_in_sql(spark, tmp_path):
    sums = [16406, 16130, 16470, 16150]  # of 640 quantities: the mean over 50 ends in a half at six digits
    rows = [(i, float(q // 640 + (j < q % 640)), 0.1) for i, q in enumerate(sums) for j in range(640)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i,) for i in range(len(sums))], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = [(r.docsim_raw, r.bm25_raw) for r in catalog.subs(spark, str(tmp_path)).orderBy("doc_id").collect()]
    c = duckdb.connect()
    want = c.execute("select round(q / 640 / 50, 6), round(64::double / 100000, 4) from (select unnest($1) as q)", [sums]).fetchall()
    assert got == want


def test_halves_of_prices_are_told_as_sql_tells_them(spark, tmp_path):
    draw = random.Random(4)
    cents = [[draw.randrange(100, 9_000_000) for _ in range(200)] for _ in range(30)]
    cents = [c[:-1] + [c[-1] + 500 - sum(c) % 1000] for c in cents]  # sums that end in five whole
    # two files, each with every supplier's rows
    for half in range(2):
        rows = [(i, x[j] / 100) for j in range(100 * half, 100 * half + 100) for i, x in enumerate(cents)]
        t = pa.table({"l_suppkey": [i for i, _ in rows], "l_quantity": [1.0] * len(rows), "l_extendedprice": [p for _, p in rows]})
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        pq.write_table(t, tmp_path / "lineitem.parquet" / f"part-{half}.parquet")
    spark.createDataFrame([(i,) for i in range(len(cents))], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = [r.bm25_raw for r in catalog.subs(spark, str(tmp_path)).orderBy("doc_id").collect()]
    c = duckdb.connect(config={"threads": 1})
    want = c.execute(f"select round(sum(l_extendedprice) / 100000, 4) from '{tmp_path}/lineitem.parquet/*.parquet' group by l_suppkey order by l_suppkey").fetchall()
    assert got == [x for x, in want]


def test_channels_are_told_as_in_sql(spark, monkeypatch):
    k = [0.285, 0.345, 0.575, 0.675, 0.155]
    of_all = spark.createDataFrame([(i, x, 1 - x, 1, 2, "NONE") for i, x in enumerate(k)], "doc_id long, k double, m double, rank_k long, rank_m long, flag string")
    monkeypatch.setattr(extracted.catalog, "prims", lambda *_: None)
    monkeypatch.setattr(extracted.fusion, "ranked", lambda *_: of_all)
    got = [r.line for r in extracted._channel_lines(spark, "").orderBy("doc_id").collect()]
    want = duckdb.connect().execute("select printf('Keyword channel %.2f, semantic channel %.2f.', round(k, 2), round(1 - k, 2)) from (select unnest($1::double[]) as k)", [k]).fetchall()
    assert [g[: g.index(". ") + 1] for g in got] == [w for w, in want]


def test_numbers_are_rounded_as_in_sql(spark):
    x = [i / 2000 for i in range(1, 4000, 2)]
    x += [v * (1 + 3e-16) for v in x] + [-v for v in x]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(rounded(F.col("x"), 2), half_even(F.col("x"), 2)).collect()
    want = duckdb.connect().execute("select round(x, 2), round_even(x, 2) from (select unnest($1::double[]) as x)", [x]).fetchall()
    assert [tuple(r) for r in got] == want


def test_intents_know_ascii_word_edges(spark):
    texts = ["erchbestä", "die bestä erch", "übest pf", "asbest", "the best.", "Top 3é", "étop 3", "topé", None, "why_not", "warum whyß"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sql = "CASE " + " ".join("WHEN regexp_matches(lower(text), '{}') THEN '{}'".format(p.replace("'", "''"), n) for n, p in text.INTENTS) + " ELSE 'FALLBACK' END"
    top = r"coalesce(regexp_extract(lower(text), '\btop\s*(\d{1,9})', 1), '')"
    want = duckdb.connect().execute(f"select {sql}, CASE WHEN {top} = '' THEN 3 ELSE {top}::INT END from (select unnest($1) as text)", [texts]).fetchall()
    got = df.select(text.intent(F.col("text")), views.top_asked(F.coalesce("text", F.lit("")), F.lit(100))).collect()
    assert [tuple(r) for r in got] == want
