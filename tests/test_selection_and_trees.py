"""Exact percentiles against NumPy, and ancestors in trees of any depth."""

import numpy as np
import pytest

from provara.operators import selection, taxonomy


@pytest.mark.parametrize("read", [20_000, 7])
def test_percentiles_equal_numpy(spark, monkeypatch, read):
    monkeypatch.setattr(selection, "READ", read)
    monkeypatch.setattr(selection, "ACCURACY", 20)
    r = np.random.default_rng(1)
    columns = {"a": r.normal(size=900), "b": r.integers(0, 4, 900).astype(float), "c": np.where(r.random(900) < 0.4, 3.5, r.random(900) * 9)}
    rows = [tuple(float(v[i]) for v in columns.values()) for i in range(900)] + [(None, None, None)] * 5
    df = spark.createDataFrame([(*x, None) for x in rows], "a double, b double, c double, none double").repartition(4)
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = selection.percentiles(df, {c: shares for c in (*columns, "none")})
    for c, v in columns.items():
        assert np.allclose(got[c], np.percentile(v, [100 * s for s in shares]), atol=1e-12, rtol=0)
    assert got["none"] == [None] * 5
    assert selection.percentiles(df.where("a > 1e9"), {"a": (0.5,)}) == {"a": [None]}


def plain_ancestors(parent):
    out = {}
    for c in parent:
        at, level = parent[c], 1
        while at is not None and (c, at) not in out:
            out[c, at] = level
            at, level = parent.get(at), level + 1
    return out


def test_ancestors_of_deep_trees_and_cycles(spark):
    parent = {f"c{i}": f"c{i - 1}" if i else None for i in range(300)}
    parent |= {"x": "y", "y": "z", "z": "x", "w": "x", "self": "self", "lost": "nowhere"}
    concepts = spark.createDataFrame(list(parent.items()) + [(None, "x")], "concept string, parent string")
    got = {(r.concept, r.ancestor): r.level for r in taxonomy.ancestors(concepts).collect()}
    assert got == plain_ancestors(parent)
    skills = spark.createDataFrame([("s", "c299"), ("t", "w"), ("u", None)], "skill string, parent string")
    up = {(r.skill, r.ancestor): r.level for r in taxonomy.closure(skills, concepts).collect()}
    assert up["s", "c0"] == 299 and up["s", "c299"] == 0 and up["t", "z"] == 3 and not any(s == "u" for s, _ in up)
    assert taxonomy.ancestors(concepts.limit(0)).count() == 0
