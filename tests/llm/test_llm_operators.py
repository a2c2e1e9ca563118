"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from provara.llm import cws, exactdedup, langid, mixing, neardedup, ordinal, packing, pii, quality, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, key int, score string, v int, bands int"


def _rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    long_ = " ".join(r.choice(words) for _ in range(6000))
    base = [r.choice(words) for _ in range(200)]
    near = base[:100] + ["zzz"] + base[101:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, "\n".join(base)), (4, None), (5, ""), (6, " \t "), (7, long_), (8, "a b"), (8, "a b"), (9, "a b"), (None, "no id at all"), (10, "mail x.y@z.example.com +1 (743) 555-3824 at 10.0.0.1 or 743-555-3824")]
    rows += [(20 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(30)]
    return [(i, t, ("en", "de", None)[k % 3], ("s0", "s1", None)[k % 3], None, "k", 1, "s", 2, 3) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(none):
    for df in (exactdedup.exact_groups(none), neardedup.near_groups(none), substrings.without_repeats(none), mixing.copies(none), mixing.mixed(none), packing.packed(none), cws.fingerprints(none), exactdedup.deduplicated(none), langid.with_language(none, langid.fit_languages(none))):
        assert df.count() == 0
    assert quality.score_quality(none, quality.fit_quality(none, none.selectExpr("doc_id", "1 as grade"))).count() == 0


def test_exact_groups(docs):
    got = exactdedup.exact_groups(docs).collect()
    groups = {}
    for i, t, *_ in _rows():
        groups.setdefault(exactdedup.bare(t), []).append((-len(t or ""), i if i is not None else 1 << 62, i))
    assert len(got) == len(_rows()) and sum(g.kept for g in got) == len(groups)
    want = {hashlib.sha256(b).hexdigest(): (min(g)[2], len(g)) for b, g in groups.items()}
    assert all(want[g.text_sha256] == (g.keep_id, g.group_size) for g in got)
    assert exactdedup.deduplicated(docs).count() == len(groups) and exactdedup.deduplicated(docs).columns == docs.columns


def test_filters_merge_losslessly():
    r = np.random.default_rng(0)
    h = r.integers(0, 1 << 64, 500, dtype=np.uint64)
    h = np.concatenate([h, h[:100], h[:3], np.array([0, 0, (1 << 64) - 1], np.uint64)])
    for bits in (0, 4, 9):
        by_range = {}
        for part in np.array_split(h, 7):
            for f in exactdedup.filters_of(part, bits):
                by_range.setdefault(f.top, []).append(f)
        merged = Counter()
        for filters in by_range.values():
            fingerprints, counts = exactdedup.CountingQuotientFilter.merged(filters).items()
            assert np.all(fingerprints[1:] > fingerprints[:-1])
            merged.update(dict(zip(fingerprints.tolist(), counts.tolist(), strict=True)))
        assert merged == Counter(h.tolist())


def test_near_groups(docs):
    got = neardedup.near_groups(docs).collect()
    by = {}
    for g in got:
        by.setdefault(g.class_id, []).append(g.doc_id)
    assert sorted(by[1]) == [1, 2, 3] and sorted(by[8]) == [8, 8, 9] and sorted(by[4]) == [4, 5, 6]
    assert len(got) == len(_rows()) and neardedup.near_deduplicated(docs).count() == len(by)


def _of_one_passage(spark, own, changed):
    """300 pairs of similarity a little above 0.8, of texts that begin with the same 160 words; texts of different pairs are below."""
    r = random.Random(1)
    some = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    passage, rows = some(160), []
    for i in range(300):
        body = some(own)
        rows += [(2 * i, " ".join(passage + body)), (2 * i + 1, " ".join(passage + body[:-changed] + some(changed)))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_pairs_that_meet_only_in_large_buckets(spark):
    got = neardedup.near_groups(_of_one_passage(spark, 28, 20)).collect()
    assert len(got) == 600 and all(g.class_id == g.doc_id // 2 * 2 and g.class_size == 2 for g in got)


def test_near_pairs_that_counts_rule_out_are_not_compared(spark, monkeypatch):
    compared, verified = [], neardedup._verified
    monkeypatch.setattr(neardedup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    got = neardedup.near_groups(_of_one_passage(spark, 28, 20)).collect()
    assert all(g.class_id == g.doc_id // 2 * 2 and g.class_size == 2 for g in got)
    # 300 pairs are alike; texts of different pairs are a little below
    assert sum(compared) < 2 * len(got)


def test_counts_by_cell_rule_out_no_alike_pair():
    r = np.random.default_rng(3)
    for n in (1, 3, 40, 400, 60_000):
        for share in (0.5, 0.75, 0.8, 0.85, 1.0):
            own = r.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2)
            x, y = own[:n], np.concatenate([own[: int(n * share)], own[n : 2 * n - int(n * share)]])
            p, q = (np.minimum(np.bincount((v >> np.uint64(57)).astype(np.int64), minlength=neardedup.CELLS), neardedup.MANY).astype(np.uint8)[None] for v in (x, y))
            both = len(np.intersect1d(x, y))
            assert neardedup._may_be_alike(p, q, 0.8)[0] or both < 0.8 * (2 * n - both)


def test_near_many_classes_in_one_bucket(spark):
    # bands of one place: any two of them together still put far more than 16 texts in a bucket
    got = neardedup.near_groups(_of_one_passage(spark, 26, 19), n_rows=1).collect()
    assert len(got) == 600 and all(g.class_id == g.doc_id // 2 * 2 and g.class_size == 2 for g in got)


def test_signature_collision_rate():
    r = np.random.default_rng(1)
    a, b = r.integers(1, 6, 200), r.integers(1, 6, 200)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    e = r.integers(0, 1 << 62, 200).astype(np.uint64)
    size = 4000
    sig = neardedup.signature(np.repeat([0, 1], 200), np.concatenate([e, e]), np.concatenate([a, b]), 2, size)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_substrings(docs):
    count, words = Counter(), {}
    for k, (_, t, *_) in enumerate(_rows()):
        words[k] = (t or "").encode().split()
        count.update(tuple(words[k][i : i + 35]) for i in range(len(words[k]) - 34))
    want = Counter()
    for k, w in words.items():
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[(_rows()[k][0], len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(map(tuple, substrings.without_repeats(docs).drop("kept_text").collect()))
    assert got == want


def test_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_mixing(docs):
    got = mixing.copies(docs).collect()
    assert sum(g.n_rows for g in got) == len(_rows()) and all(0 <= g.copies + (g.extra > 0) <= 2 for g in got)
    for s in {g.source for g in got}:
        own = [g for g in got if g.source == s]
        taken = sum(g.size * (g.copies * g.n_rows + g.extra) for g in own)
        assert abs(taken - own[0].target) <= max(g.size for g in own)
    assert got == mixing.copies(docs).collect() or sorted(map(str, got)) == sorted(map(str, mixing.copies(docs).collect()))
    assert mixing.mixed(docs).columns == docs.columns


def test_packing(docs):
    got = packing.packed(docs, capacity=256).collect()
    assert sum(g.n_words for g in got) == sum(len((t or "").encode().split()) for _, t, *_ in _rows())
    bins = Counter()
    for g in got:
        bins[g.bin_id] += g.n_words
    assert max(bins.values()) <= 256
    assert len({g.bin_id for g in got if g.doc_id in (8, 9)}) == 3  # equal texts part


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.best_fit([(6, "a", 1), (7, "a", 2), (3, "b", 3), (4, "b", 2)], 10, 1) == [1, 0, 0, 1]
    assert packing.best_fit([(2, "a", 1)] * 3, 10, 4) == [0, 1, 2]


def test_fingerprints(docs):
    got = cws.fingerprints(docs).collect()
    texts = sorted(((i, t or "") for i, t, *_ in _rows()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    digest = Counter((i, hashlib.sha256((t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(texts))
    assert Counter((g.doc_id, g.edited_sha256) for g in got) == digest
    by = {g.doc_id: g for g in got}
    assert by[4].fingerprint == by[5].fingerprint == by[6].fingerprint and by[8].fingerprint == by[9].fingerprint and by[1].fingerprint == by[3].fingerprint
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)


def test_personal_data(docs):
    found = {r.doc_id: r.p for r in docs.select("doc_id", pii.personal_data(docs.text).alias("p")).collect()}
    assert [(s.kind, s.start, s.end) for s in found[10].base] == [("email", 5, 22), ("ip", 44, 52), ("phone", 23, 40)]
    assert [(s.kind, s.start) for s in found[10].added] == [("phone", 56)]
    assert found[4].base == [] and found[7].base == [] and found[4].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_ordinal_recovers_grades():
    r = np.random.default_rng(2)
    w = np.zeros(1 << ordinal.BITS)
    w[:4] = [2, -2, 1, 0]
    x = r.normal(size=(3000, 4))
    z = x @ w[:4] + r.logistic(size=3000)
    rank = np.searchsorted([-2, 0, 2], z)
    th, fitted = ordinal.solve(np.repeat(np.arange(3000), 4), np.tile(np.arange(4), 3000), x.ravel(), rank, 4, 1e-4, 200)
    assert np.all(np.diff(th) > 0) and np.abs(fitted[:4] - w[:4]).max() < 0.35 and np.abs(th - [-2, 0, 2]).max() < 0.35


def test_quality_and_toxicity(spark, docs):
    train = spark.createDataFrame([(i, "good words here " * 3 if i % 2 else "bad!! JUNK!! idiot " * 3) for i in range(60)], "doc_id long, text string")
    q = quality.fit_quality(train, train.selectExpr("doc_id", "doc_id % 2 as grade"))
    told = {r.doc_id: r for r in quality.score_quality(train, q).collect()}
    assert all(told[i].keep == bool(i % 2) for i in told)
    t = toxicity.fit_toxicity(train, train.selectExpr("doc_id", "1 - doc_id % 2 as grade"))
    assert all(r.toxic == (r.doc_id % 2 == 0) for r in toxicity.score_toxicity(train, t).collect())
    assert quality.score_quality(docs, q).count() == len(_rows())
    assert not [r for r in toxicity.score_toxicity(docs, t).collect() if not r.text and r.toxic]


def test_language(spark):
    train = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    m = langid.fit_languages(train)
    test = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, None), (4, "12 !!"), (5, "the cat and the dog the cat and the dog der hund und die katze der hund und die katze")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.with_language(test, m).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and set(got[5].languages) == {"en", "de"}


def test_personal_data_far_from_the_base_form():
    again = "or 123-4567 word " * 20
    for text in ("+1 (555) 123-4567 word " + again, again + "+1 (555) 123-4567", again + "+1 (555) 123-4567 word " + again):
        base, more = pii.find(text, pii.fitted())
        assert len(base["phone"]) == 1 and [text[s:e] for _, s, e in more] == ["123-4567"] * text.count("or 123-4567")
    assert not pii.find(again, pii.fitted())[1]
