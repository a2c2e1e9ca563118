"""Operators against brute force, on hot keys, clashing names and texts made to collide; queries and pipeline stages."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provara.llm import arrowtext, cws, exactdedup, langid, mixing, neardedup, packing, pii, quality, queries, shared, substrings, toxicity

#: Names that the operators use themselves.
CLASHES = ("k", "provara_key", "provara_part", "copies", "m_source", "key", "key2", "row", "n", "times", "kept", "fp", "rid", "salt", "best", "v", "root", "band", "bucket", "order", "lows", "place", "n_rows", "extra", "size", "shard", "repeat", "grade", "feature", "a.b")


def some_words(r, n, letters="abcdefghijklmnop"):
    return ["".join(r.choice(letters) for _ in range(7)) for _ in range(n)]


def mixed_rows(seed=5):
    """Unique texts, near copies, many repeated rows, copies under other ids, nulls, empty and long texts, a hot source."""
    r = random.Random(seed)
    rows = []
    for i in range(40):
        words = some_words(r, r.randint(1, 90))
        rows.append((i, " ".join(words), ("s0", "s0", "s1", None)[i % 4]))
        if i % 4 == 0:
            rows.append((100 + i, " ".join([*words[:-1], "changed"]), "s0"))
            rows.append((200 + i, "  ".join(words), "s1"))
    rows += [(7, rows[7][1], "s0")] * 30 + [(None, "no id at all here", "s1")] * 3 + [(-1, "no id at all here", "s1")]
    rows += [(300, None, "s0"), (301, "", "s0"), (302, " \t", None), (303, " ".join(some_words(r, 7000)), "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    df = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string").repartition(3)
    df = df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    df.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))) for c in CLASHES}).write.parquet(path)
    return spark.read.parquet(path)


def key(df):
    return sorted(map(str, df.collect()))


def test_names_do_not_clash(docs, spark):
    model = quality.fit_quality(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int"))
    whole = Counter(map(str, docs.collect()))
    for df in (exactdedup.deduplicated(docs), neardedup.near_deduplicated(docs), mixing.mixed(docs)):
        assert df.columns == docs.columns
        assert set(map(str, df.collect())) <= set(whole)
    assert Counter(map(str, quality.score_quality(docs, model).select(*(F.col(f"`{c}`") for c in docs.columns)).collect())) == whole
    for df in (cws.fingerprints(docs), packing.packed(docs), substrings.without_repeats(docs), exactdedup.exact_groups(docs), toxicity.score_toxicity(docs, model), langid.with_language(docs, langid.fit_languages(docs)), docs.select(pii.personal_data(F.col("text")))):
        assert df.count() >= len(mixed_rows())


def test_hot_keys_and_large_tables_give_the_same_rows(docs, monkeypatch):
    runs = {
        "exact": lambda: exactdedup.exact_groups(docs),
        "exact_dedup": lambda: exactdedup.deduplicated(docs).select("doc_id", "text"),
        "near": lambda: neardedup.near_groups(docs),
        "near_dedup": lambda: neardedup.near_deduplicated(docs).select("doc_id", "text"),
        "substrings": lambda: substrings.without_repeats(docs),
        "fingerprints": lambda: cws.fingerprints(docs),
        "mixed": lambda: mixing.mixed(docs).select("doc_id", "text", "source"),
        "packed": lambda: packing.packed(docs),
    }
    before = {n: key(f()) for n, f in runs.items()}
    monkeypatch.setattr(shared, "few", lambda df, limit=0: False)
    monkeypatch.setattr(shared, "SALT_ROWS", 4)
    monkeypatch.setattr(exactdedup, "SALT_ROWS", 3)
    monkeypatch.setattr(neardedup, "SMALL", 2)
    assert {n: key(f()) for n, f in runs.items()} == before


def test_tables_of_a_call_go(docs, spark):
    shared.written(spark.range(3))
    fs, p = shared._file_system(spark, shared.folder(spark))
    with shared.Scratch(spark) as tables:
        before = len(fs.listStatus(p))
        with shared.Scratch(spark) as inner:
            kept = inner.keep(shared.written(spark.range(5)))
        assert kept.count() == 5 and len(fs.listStatus(p)) == before + 1
        assert tables.paths
    assert len(fs.listStatus(p)) == before


def test_two_threads_keep_their_own_tables(spark):
    import threading

    inner, outer, failed = threading.Event(), threading.Event(), []

    def other():
        try:
            with shared.Scratch(spark) as tables:
                df = shared.written(spark.range(4))
                inner.set()
                assert outer.wait(60) and df.count() == 4 and len(tables.paths) == 1
        except Exception as e:
            failed.append(e)

    with shared.Scratch(spark) as tables:
        t = threading.Thread(target=other)
        t.start()
        assert inner.wait(60)
        shared.written(spark.range(2))
        assert len(tables.paths) == 1
    outer.set()
    t.join()
    assert not failed


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "the cat", 5, 6, 7)], "doc_id long, text string, provara_graded int, provara_lang int, row int")
    model = quality.fit_quality(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int"))
    for df in (quality.score_quality(docs, model), toxicity.score_toxicity(docs, model), langid.with_language(docs, langid.fit_languages(docs.withColumn("lang", F.lit("en"))))):
        row = df.first()
        assert (row.provara_graded, row.provara_lang, row.row) == (5, 6, 7)


def test_a_null_id_is_no_other(spark):
    rows = spark.createDataFrame([(None, "a"), (-1, "a"), (-1, None), (-1, "")], "doc_id long, text string").select(*shared.row_key()).collect()
    assert rows[0] != rows[1] and rows[1] != rows[2] and rows[2] == rows[3]


def thue_morse(n, a="a", b="b"):
    return "".join((b if i.bit_count() % 2 else a) for i in range(n))


def test_texts_that_collide_in_rolling_hashes_stay_apart(spark):
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    rest = " ".join(f"w{i}" for i in range(34))
    d = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, one), (4, two)], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substrings.without_repeats(d).collect())
    assert {(r.doc_id, r.class_id) for r in neardedup.near_groups(d.where("doc_id > 2")).collect()} == {(3, 3), (4, 4)}
    words = arrowtext.mix(np.arange(2, dtype=np.uint64))[[i.bit_count() % 2 for i in range(4096)]]
    hashes = arrowtext.window_hashes(np.concatenate([words, words[::-1]]), 2048)
    runs = np.concatenate([words, words[::-1]]).tolist()
    assert len(set(hashes.tolist())) == len({tuple(runs[i : i + 2048]) for i in range(len(hashes))})


def bag(text, size=5):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else Counter([tuple(words)] if words else [])


def test_near_classes_equal_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(90):
        words = some_words(r, r.randint(20, 120))
        for j in range(r.randint(1, 5)):
            changed = list(words)
            for _ in range(r.randint(0, 3)):
                changed[r.randrange(len(changed))] = "".join(some_words(r, 1))
            rows.append((10 * i + j, " ".join(changed)))
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        small, large = sorted((bags[a].total(), bags[b].total()))
        if small >= 0.8 * large and (both := (bags[a] & bags[b]).total()) and both / (small + large - both) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
            close += 1
    want = {(rows[a][0], rows[find(a)][0]) for a in range(len(rows))}
    got = neardedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert close > 60 and {(g.doc_id, g.class_id) for g in got} == want


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets_equal_brute_force(spark):
    r = random.Random(4)
    for _ in range(3):
        rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "b", "c", "d", "é", None]) if i % 3 else "a") for i in range(200)]
        sizes = Counter()
        for _, t, s in rows:
            sizes[s] += len(t.split())
        want = brute_targets(sizes)
        got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert all(abs(g.target - want[g.source]) < 1e-6 * (1 + want[g.source]) and g.source_size == sizes[g.source] for g in got)
        for s in sizes:
            taken = sum(g.size * (g.copies * g.n_rows + g.extra) for g in got if g.source == s)
            assert abs(taken - want[s]) <= 30


def test_repeated_rows_are_rounded_one_by_one(spark):
    rows = [(1, "a b c d", "x")] * 1000 + [(2, "a b", "x")] + [(3, "a b c d", "y")] * 2000
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.copies(d).collect()
    for s in "xy":
        own = [g for g in got if g.source == s]
        assert abs(sum(g.size * (g.copies * g.n_rows + g.extra) for g in own) - own[0].target) <= 4
    per_row = Counter((g.doc_id, g.copies + (i < g.extra)) for g in got for i in range(g.n_rows))
    assert all(0 <= c <= 2 for _, c in per_row)
    want = Counter({g.doc_id: g.copies * g.n_rows + g.extra for g in got})
    assert Counter(r.doc_id for r in mixing.mixed(d).collect()) == +want


def generalised_jaccard(a, b):
    x, y = (Counter(t.split()) or Counter([""]) for t in (a, b))
    return (x & y).total() / (x | y).total()


def test_fingerprints_equal_brute_force_over_many_buckets(spark):
    r = random.Random(2)
    vocabulary = some_words(r, 60)
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 80)))) for i in range(300)]
    rows += [(42, f"{t} x") for _, t in rows[:60]] + [(None, t) for _, t in rows[:20]] + [(17, "same row again")] * 25
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = d.select("doc_id", "text", *shared.text_key()).collect()
    ordered.sort(key=lambda x: (x.doc_id is None, -(x.doc_id or 0), x.key, x.key2))
    want, errors = Counter(), []
    exact = {}
    for k, x in enumerate(ordered):
        n, next_ = len(x.text), ordered[(k + 1) % len(ordered)].text
        edited = x.text[: n - n // 2] + next_[: n // 2]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[(x.doc_id, n, digest)] += 1
        exact[(x.doc_id, digest)] = (generalised_jaccard(x.text, edited), generalised_jaccard(x.text, next_))
    got = cws.fingerprints(d).collect()
    assert Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == want
    for g in got:
        for likeness, true in zip((g.near_edited, g.near_next), exact[(g.doc_id, g.edited_sha256)], strict=True):
            errors.append(likeness - true)
    # the texts share their words and so their samples: the mean error is not that of independent draws
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.07


def test_fingerprints_of_separate_vocabularies_are_unbiased(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        own = [f"w{i}x{j}" for j in range(40)]
        rows.append((3 * i, " ".join(r.choice(own) for _ in range(r.randint(20, 80)))))
        rows.append((3 * i + 1, " ".join(r.choice(own) for _ in range(r.randint(20, 80)))))
    got = {g.doc_id: g.near_next for g in cws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    # by descending doc_id the next of 3i + 1 is 3i, of the same words
    errors = [got[3 * i + 1] - generalised_jaccard(texts[3 * i + 1], texts[3 * i]) for i in range(400)]
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.07


def brute_fit(pieces, capacity, lanes):
    bins, out, clock = [], [0] * len(pieces), 0
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        size, source, cluster = pieces[i]
        clock += 1
        fits = [b for b in bins if b["left"] >= size and (not size or (cluster not in b["clusters"] and b["sources"][source] < lanes))]
        if fits:
            b = min(fits, key=lambda b: (b["left"], b["since"]))
        else:
            b = {"name": len(bins), "left": capacity, "sources": Counter(), "clusters": set(), "since": clock}
            bins.append(b)
        if size:
            b["sources"][source] += 1
            b["clusters"].add(cluster)
            b["left"], b["since"] = b["left"] - size, clock
        out[i] = b["name"]
    return out


def test_best_fit_equals_brute_force():
    r = random.Random(0)
    for _ in range(200):
        pieces = [(r.randint(0, 20), r.choice("abc"), r.randint(0, 6)) for _ in range(r.randint(1, 60))]
        assert packing.best_fit(pieces, 20, 2) == brute_fit(pieces, 20, 2)
    assert packing.best_fit([(3, "a", 1)] * 20_000, 2048, 4) == list(range(20_000))


def test_bins_do_not_depend_on_how_rows_are_dealt(docs):
    assert key(packing.packed(docs, capacity=64)) == key(packing.packed(docs.repartition(7), capacity=64))


def test_base_spans_of_long_digit_runs():
    assert pii.base_spans("0" * 5000 + ".1.1.1")["ip"] == [(0, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1")["ip"] == []
    many = ",".join(f"10.0.0.{i}" for i in range(12))
    assert {t.base for t in pii.tokens(many, pii.base_spans(many))} == {2}


def test_field_finds_mentions_in_other_forms():
    r = random.Random(3)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    found = planted = wrong = 0
    for _ in range(60):
        a, b, c, u = digits(3), digits(3), digits(4), "user" + digits(2)
        plain = [f"+1 ({a}) {b}-{c}", f"{u}@mail.example.com"]
        other = [f"{a}-{b}-{c}", f"{u}@mail"]
        filler = [f"{digits(3)}-{digits(4)}", digits(6), "word", f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"]
        parts = plain + other * 2 + filler
        r.shuffle(parts)
        text = " then ".join(parts)
        _, more = pii.find(text, pii.fitted())
        said = Counter(text[s:e] for _, s, e in more)
        planted += 4
        found += sum(min(2, said[o]) for o in other)
        wrong += sum(n for t, n in said.items() if t not in other)
    assert found >= 0.9 * planted and wrong <= 0.05 * planted


def test_mentions_side_by_side_stay_apart():
    said = lambda t: [t[s:e] for _, s, e in pii.find(t, pii.fitted())[1]]
    many = "+1 (555) 123-4567 or 123-4567 123-4567 123-4567"
    assert said(many) == ["123-4567"] * 3
    assert all(len(x) <= 14 for x in said("555-0001 555-0002 555-0003 555-0001 555-0002 555-0003"))


def test_base_spans_equal_the_patterns():
    r = random.Random(8)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    n_digits = lambda t: sum("0" <= c <= "9" for c in t)
    for _ in range(4000):
        text = "".join(r.choice(["1", "4", "0", "555", "4111 1111 1111 1111", "10.0.0.1", "+1 (555) 123-4567", "a", "@", ".", "-", "+", " ", "(", "a@b.c", "é"]) for _ in range(r.randint(0, 12)))
        want = {
            "email": [m.span() for m in email.finditer(text)],
            "ip": [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
            "card": [m.span() for m in card.finditer(text) if 13 <= n_digits(m[0]) <= 19 and pii.luhn("".join(c for c in m[0] if c.isdigit()))],
            "phone": [m.span() for m in phone.finditer(text) if 9 <= n_digits(m[0]) <= 15],
        }
        assert pii.base_spans(text) == want, text


def test_field_equals_enumeration_where_it_has_no_loops():
    field = pii.fitted()
    for text in ("call 123-4567 or 99 then", "u12@mail and 5551234567", "+1 (555) 123-4567 or 123-4567"):
        ts = pii.tokens(text, pii.base_spans(text))
        near, far = pii.chains(ts), [(a, b) for a, b in pii.links(ts) if not ts[a].base and not ts[b].base]
        joined = {a for a, _ in near}, {b for _, b in near}
        own = np.array([field.unary[pii.unary(t, i in joined[1], i in joined[0])].sum(axis=0) for i, t in enumerate(ts)]) + pii.known(ts) @ field.skip
        total = np.zeros((len(ts), len(pii.LABELS)))
        for labels in itertools.product(range(len(pii.LABELS)), repeat=len(ts)):
            if any(t.base and x != t.base for t, x in zip(ts, labels, strict=True)):
                continue
            score = sum(own[i, x] for i, x in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in near) + sum(field.skip[labels[a], labels[b]] for a, b in far)
            total[np.arange(len(ts)), labels] += np.exp(score)
        want = total / total.sum(axis=1, keepdims=True)
        assert np.abs(field.marginals(ts) - want).max() < 1e-3, text


def plain_loss(x, rank, weights, at):
    z, up = x @ weights, np.append(at, np.inf)
    low = np.insert(at, 0, -np.inf)
    p = 1 / (1 + np.exp(-(up[rank] - z))) - 1 / (1 + np.exp(-(low[rank] - z)))
    return -np.log(p).mean()


def test_ordinal_fit_equals_a_plain_optimiser():
    from provara.llm import ordinal

    r = np.random.default_rng(3)
    x = (r.random((300, 6)) < 0.4) * r.random((300, 6))
    rank = np.digitize(x @ np.array([3.0, -3, 2, 0, 0, 0]) + r.logistic(size=300), [-0.5, 0.5, 1.5])
    row, feature = np.nonzero(x)
    at, weights = ordinal.solve(row.astype(np.int32), feature.astype(np.int32), x[row, feature].astype(np.float32), rank, 4, 1e-3, 3000)
    loss = lambda v: plain_loss(x, rank, v[3:], np.cumsum([v[0], *np.exp(v[1:3])])) + 1e-3 * np.abs(v[3:]).sum()
    v = np.zeros(9)
    v[1:3] = -1
    step = np.full(9, 0.5)
    while step.max() > 1e-5:  # one coordinate after the other, with shrinking steps
        for i in range(9):
            for sign in (1, -1):
                w = v.copy()
                w[i] += sign * step[i]
                if loss(w) < loss(v):
                    v = w
                    break
            else:
                step[i] *= 0.7
    got = plain_loss(x, rank, weights[:6], at) + 1e-3 * np.abs(weights).sum()
    assert got <= loss(v) + 1e-3
    model = ordinal.OrdinalModel(quality.FEATURES, (0, 1, 2, 3), tuple(map(float, at)), tuple(range(6)), tuple(map(float, weights[:6])))
    assert model.thresholds == tuple(map(float, at))


def test_grades_equal_a_plain_loop():
    from provara.llm import ordinal
    import pyarrow as pa

    text = ["one two two three", "", "three", "one"]
    features = quality.FEATURES
    r = np.random.default_rng(1)
    index = tuple(sorted({int(f) for s in features.slices(pa.array(text)) for f in features.of(s)[1]}))
    model = ordinal.OrdinalModel(features, (0, 2, 5), (-0.3, 0.8), index, tuple(r.normal(size=len(index))))
    weight = dict(zip(index, model.weight, strict=True))
    expected, tail = model.graded(pa.array(text), 2)
    for i, t in enumerate(text):
        z = sum(weight[int(f)] * float(v) for s in features.slices(pa.array([t])) for _, f, v in zip(*features.of(s), strict=True))
        above = [1 - 1 / (1 + math.exp(-(c - z))) for c in model.thresholds]  # of grade 2 or more, of grade 5
        assert abs(tail[i] - above[0]) < 1e-5 and abs(expected[i] - (2 * (above[0] - above[1]) + 5 * above[1])) < 1e-4


def test_no_letter_no_language(spark):
    train = spark.createDataFrame([("the cat", "en"), ("die katze", "de")], "text string, lang string")
    d = spark.createDataFrame([("\u00b2 \u00bd",), ("12",), ("",), (None,), ("the",)], "text string")
    got = langid.with_language(d, langid.fit_languages(train)).collect()
    assert [g.lang_pred for g in got] == ["und"] * 4 + ["en"] and all(0 <= g.score <= 1 for g in got)


def test_mixture_equals_brute_force():
    r = np.random.default_rng(7)
    n_words = r.integers(1, 60, 40)
    p = np.maximum(r.random((n_words.sum(), 4)) ** 6, 1e-9)
    p /= p.max(axis=1, keepdims=True)
    at = np.concatenate([[0], np.cumsum(n_words)])

    def climbed(q, some):
        pi = np.zeros(4)
        pi[list(some)] = 1 / len(some)
        for _ in range(5000):
            w = q * pi
            pi = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
        return pi, np.log((q * pi).sum(axis=1)).sum()

    pi, ll, gap = langid.mixture(p, n_words, np.ones((40, 4)))
    best, value = langid.select(p, n_words, pi, ll, gap)
    for i in range(40):
        q = p[at[i] : at[i + 1]]
        full, most = climbed(q, range(4))
        assert ll[i] <= most + 1e-9 <= ll[i] + gap[i] + 1e-6
        order = np.argsort(-pi[i], kind="stable")
        sets = [(int(np.log(q).sum(axis=0).argmax()),)] + [tuple(order[:m]) for m in (2, 3, 4)]
        values = [climbed(q, s)[1] - 0.5 * len(s) * np.log(max(2, n_words[i])) for s in sets]
        assert abs(value[i] - max(values)) < 0.05


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(i % 5 != 0), int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_queries_have_their_columns_and_rows(spark, folder):
    want = {
        "op1_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op2_near_dedup": {"doc_id", "class_id"},
        "op3_quality": {"doc_id", "keep"},
        "op4_packing": {"doc_id", "piece", "first_word", "n_words", "bin_id"},
        "op5_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
        "op6_language": {"doc_id", "held_out", "lang_pred", "score"},
        "op7_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
        "op8_mixing": {"doc_id", "size", "source_size", "target", "taken"},
        "op9_toxicity": {"doc_id", "toxic"},
        "op10_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
        "op12_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    }
    assert set(want) | {"op11_centroids", "op13_prefix_trie"} == set(queries.QUERIES)  # those read other tables
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, folder)
        assert columns <= set(got.columns)
        rows = got.collect()
        assert len(rows) >= len(mixed_rows()) if name == "op4_packing" else len(rows) == len(mixed_rows())
        if name == "op6_language":
            assert all(r.held_out is not None for r in rows)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert last or after.columns == docs.columns
        assert stage(spark, before.limit(0), folder).count() == 0
        after.write.mode("overwrite").parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        had, has = Counter(map(str, before.collect())), Counter(map(str, after.collect()))
        texts = [r.text for r in before.collect()]
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert not has - had
        if name == "exact_dedup":
            assert after.count() == len({exactdedup.bare(t) for t in texts})
        if name == "near_dedup":
            bags = [bag(r.text) for r in after.collect()]
            assert all((a & b).total() < 0.8 * (a | b).total() for a, b in itertools.combinations(bags, 2))
        if name == "mixing":
            assert set(has) <= set(had) and max(has.values()) <= 2
        if last:
            assert after.groupBy("bin_id").agg(F.sum("n_words").alias("n")).where(f"n > {packing.CAPACITY}").count() == 0
            assert after.agg(F.sum("n_words")).first()[0] == sum(len((t or "").encode().split()) for t in texts)
        before = after
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "piece", "first_word", "n_words", "bin_id"]
