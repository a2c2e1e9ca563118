"""Centroids, SentencePiece and prefix tries against plain versions, and their cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from provara.llm import centroids, pieces, queries, trie

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in named[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min(range(len(at)), key=lambda c: (away(v, at[c]), c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[place(v)].append(v)
        at = [[sum(x) // len(own[c]) for x in zip(*own[c], strict=True)] if own[c] else at[c] for c in range(len(at))]
    told = [(i, place(v), away(v, at[place(v)])) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in told:
        inertia[c] += d
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), tuple(at[c])) for i, c, d in told)


def told_clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


def test_clusters_equal_a_plain_loop(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.5, -0.25, 0.1, 0.5, 2.0]) * r.random() for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[0][1])] * 150 + [(i, [0.0] * 4) for i in range(400, 420)]  # repeated rows and ties
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0]), (None, [0.3] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumns({c: F.lit(1) for c in ("v", "cluster", "n", "label")})
    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((16, 3), (3, 6), (500, 2)):
        assert told_clusters(centroids.clustered(df, k, rounds, 4)) == plain_clusters(exact, k, rounds, 4, 64)


def test_clusters_of_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.clustered(empty).collect() == []
    nameless = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert told_clusters(centroids.clustered(nameless, dims=2)) == [("None", 0, 0, 0, 0, (64, 128))]
    large = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<float>")
    assert [r.distance for r in centroids.clustered(large, k=1, rounds=0, dims=2).orderBy("distance").collect()] == [0, (1 << 28) ** 2]


def test_the_annulus_leaves_most_centroids_out():
    r = np.random.default_rng(4)
    at = np.rint(r.normal(size=(200, 8)) * r.uniform(1, 60, (200, 1))).astype(np.int64)
    x = at[r.integers(0, 200, 3000)] + r.integers(-1, 2, (3000, 8))
    label, best, compared = centroids.nearest(x, at)
    every = ((x[:, None] - at[None]) ** 2).sum(2)
    assert (label == every.argmin(1)).all() and (best == every.min(1)).all()
    assert compared < 0.3 * every.size


def test_edges_of_the_annulus_count():
    at = np.array([[0, 5], [5, 0], [0, -5], [10, 0], [3, 4]])
    x = np.array([[0, 0], [5, 5], [10, 0], [7, 0], [0, 5]])
    every = ((x[:, None] - at[None]) ** 2).sum(2)
    label, best, _ = centroids.nearest(x, at)
    assert label.tolist() == every.argmin(1).tolist() and best.tolist() == every.min(1).tolist()


@pytest.fixture(scope="module")
def words():
    return pieces.vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n, seed):
    r = random.Random(seed)
    letters = "abc ▁\n\t\x00é漢字𝄞 <0x41></s>.,'²—  the ing tion ▁▁ ​﻿"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


def test_pieces_equal_the_library(words):
    own, library = words
    texts = [*odd_texts(3000, 1), " ", "  a", "a  ", "▁", "x" * 3000, "aaaaab" * 700, "don't.stop e.g. it's 1.5²."]
    for t in texts:
        ids = library.encode(t, add_eos=True)
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids)


def test_any_ids_are_decoded_as_by_the_library(words):
    own, library = words
    r = random.Random(2)
    for _ in range(4000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


def test_both_agendas_merge_alike(words):
    r = random.Random(3)
    for _ in range(3000):
        part = "".join(r.choice("▁theingaor er") for _ in range(r.randrange(1, 40)))
        assert words[0]._by_list(part) == words[0]._by_heap(part)


def test_whole_texts_are_encoded_in_batches(spark, words, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 500)
    monkeypatch.setattr(pieces, "STORE", 20)
    texts = [*odd_texts(200, 5), "", None, "long " * 9000, "n" * 20_000]
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in pieces.encoded(docs, MODEL).collect())
    library = words[1]
    want = sorted((str(i), ids := library.encode(t or "", add_eos=True), library.decode(ids)) for i, t, _ in rows)
    assert got == want
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0


def test_a_difference_from_the_library_ends_the_job(words):
    own = pieces.vocabulary(MODEL)
    own.scores = {p: s for p, s in own.scores.items() if p != "ing"}
    with pytest.raises(ValueError, match="by the library"):
        pieces._Store(own, True).take({"▁xing"})


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as format_

    m = format_.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.vocabulary(str(tmp_path / "m"))


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    members, last = defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + own[c][h:]
        last[c] = tuple(turns)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(node[-1][1]) * (len(members[node]) - 1) if node else 0)
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(kids[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in m if last[c] == n).encode()).hexdigest())
        for n, m in members.items()
    )


def told_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def some_turns(seed, n=400):
    r = random.Random(seed)
    rows = []
    for c in [*range(n // 2), *r.sample(range(-300, 4000), n // 2)]:
        same = r.random() < 0.3
        for turn in range(r.randint(0, 9) or 1):
            text = f"t{turn}" if same else r.choice(["a", "b", "", None, "long é𝄞 text"]) if r.random() < 0.7 else f"own {c} {turn}"
            rows.append((c, r.choice([turn, turn, None, 2]), r.choice(["user", "user", "assistant", None]) if not same else "user", text))
    rows += [(500, i, "user", f"x{i % 7}") for i in range(900)] + [(501, i, "user", f"x{i % 7}") for i in range(700)]  # hot conversations
    rows += [(502, 1, "user", "again")] * 300 + [(None, 1, "user", "no id"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize(("parts", "fan", "nodes"), [(4, 64, 100_000), (23, 2, 50)])
def test_tries_equal_a_plain_version(spark, monkeypatch, parts, fan, nodes):
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "NODES", nodes)
    rows = some_turns(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
        df = df.withColumns({c: F.lit(1) for c in ("part", "k1", "digest", "n_convs")})
        assert told_trie(trie.prefix_trie(df)) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_tries_of_few_or_no_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(None, 1, "user", "a")], [(5, None, None, None)], [(117, 1, "user", "a")], [(100, 1, "user", "a"), (117, 1, "user", "b")]):
        assert told_trie(trie.prefix_trie(spark.createDataFrame(rows, schema))) == plain_trie(rows)


def test_long_chains_are_rolled_up(spark):
    rows = [(c, i, "user", f"x{i}") for c in (100, 200) for i in range(1000)]
    got = told_trie(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == plain_trie(rows) and len(got) == 1001


def test_queries_read_their_tables(spark, tmp_path):
    rows = some_turns(9, 60)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert told_trie(queries.op13_prefix_trie(spark, str(tmp_path))) == plain_trie(rows)
    r = random.Random(7)
    vectors = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(80)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_centroids(spark, str(tmp_path)).collect()
    want = plain_clusters(vectors, 16, 3, 64, 64)
    digest = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    assert sorted((str(g.vec_id), g.cluster, g.distance, g.centroid_sha256) for g in got) == [(i, c, d, digest(v)) for i, c, d, _, _, v in want]
