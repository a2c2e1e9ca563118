"""Near-dedup by BagMinHash: weighted-Jaccard signatures, banding, verified overlap.

A document is the multiset of its runs of five words (of all its words if it
has fewer). Each element's weight axis is cut into dyadic blocks [0,1), [1,2),
[2,4), ...; a block of length L has a Poisson process of rate L, whose points
carry a time, a signature place and a level within the block, all hashed from
element and block. A document takes the points below its element's weight, in
order of time, until they exceed the greatest value in its signature; each place
keeps its least time. Two documents agree at a place with the probability of
their weighted Jaccard similarity.

28 bands of 5 places miss a pair at similarity 0.8 with probability 1.5e-5, and
fewer above. Documents of equal words (128 bits of them) are one vertex. In each
bucket all vertices are first compared with the one that meets most others. Members
of buckets carry how many of their shingles fall in each of CELLS ranges of hashes:
two texts have no more in common than the lesser counts add up to, so pairs that
these show to be below ``least`` are never made. Buckets that then
still hold several components are compared with further members picked by hash.
What is still open is compared between components without a further miss: small
buckets in full, the members of all larger ones by an exact join on the rarest
shingles of each (prefix, length and position filter), which leaves out only
pairs that cannot reach ``least``. Every comparison is of the whole multisets, of
64-bit hashes of shingles. Classes are the components of pairs of similarity
``least`` or more; they are found by passing least labels on, with every round
written to the shared folder.

Joins on bands, vertices and components deal keys of many rows over several
tasks (shared.dealt), and groups are summed up before they are shuffled.

Null texts count as empty; texts without words are equal to each other. Rows
with null doc_id take part; class_id is the least doc_id of the class, null if
it has none. Repeated rows are in one class, and all marked as kept if one is;
near_deduplicated() leaves one. Ties are broken by doc_id, then by row key. A text
is never cut, so a task needs some thirty times the bytes of its longest text.
Columns of docs besides doc_id and text are not looked at and may have any name.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provara.llm import shared
from provara.llm.arrowtext import Slice, mix, slices, window_hashes, within

SHINGLE, BANDS, ROWS = 5, 28, 5
#: Members by which a bucket of several components is compared in a round, and rounds at most.
HUBS, HUB_ROUNDS = 3, 2
#: Buckets up to this size are compared in full between components; the members of larger ones by common rare shingles.
SMALL = 16
#: Shingles that so many bags have count as frequent, and at most so many of them are ranked by it; neither has a bearing on results.
COMMON, RANKED = 8, 100_000
#: Ranges of hashes in which a bag's shingles are counted, up to MANY in one byte; MANY stands for any more.
CELLS, MANY = 128, 255
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(s: Slice, words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle; sorted by row."""
    at = within(s.first, size)
    row, value = np.searchsorted(s.first, at, "right") - 1, window_hashes(words, size)[at] if len(at) else np.zeros(0, np.uint64)
    for n in range(1, size):
        short = np.flatnonzero(s.n_words == n)
        if len(short):
            row, value = np.concatenate([row, short]), np.concatenate([value, window_hashes(words, n)[s.first[short]]])
    order = np.lexsort((value, row))
    return row[order], value[order]


def signature(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """BagMinHash signatures (row x place, float64; inf in rows without elements) of elements with whole-number weights."""
    blocks = 1 + np.array([int(w - 1).bit_length() for w in range(1, int(weight.max()) + 1)] if len(weight) else [], np.int64)
    n_blocks = blocks[weight - 1] if len(weight) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(row)), n_blocks)
    ends = np.cumsum(n_blocks)
    block = np.arange(len(which)) - np.repeat(ends - n_blocks, n_blocks)
    row, seed, weight = row[which], mix(element[which] + (block + 1).astype(np.uint64) * _G), weight[which]
    start = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    length = np.maximum(start, 1)
    sig, time, limit = np.full(n_rows * size, np.inf), np.zeros(len(row)), np.full(n_rows, np.inf)
    i = 0
    while len(row):
        i += 1
        x = mix(seed + np.uint64(i * int(_G) & (1 << 64) - 1))
        time = time - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / length
        alive = time < limit[row]
        row, seed, weight, start, length, time, x = (v[alive] for v in (row, seed, weight, start, length, time, x))
        y = mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        place = ((y >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        level = start + (((y & np.uint64(0xFFFFFFFF)) * length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        below = level < weight
        np.minimum.at(sig, row[below] * size + place[below], time[below])
        limit = sig.reshape(n_rows, size).max(axis=1)
    return sig.reshape(n_rows, size)


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Key of each band of each row."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), n_bands, rows)
    key = np.broadcast_to((np.arange(n_bands, dtype=np.uint64) + np.uint64(1)) * _G, bits.shape[:2])
    for j in range(rows):
        key = mix(key ^ bits[:, :, j])
    return key


def _distinct(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where each run of equal shingles of one row begins."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return np.flatnonzero(new)


def _signed(size: int, n_bands: int, n_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                n, words = len(s.rows), s.word_hashes()
                row, value = shingles(s, words, size)
                at = _distinct(row, value)
                weight = np.diff(np.append(at, len(row)))
                keys = bands(signature(row[at], value[at], weight, n, n_bands * n_rows), n_bands, n_rows)
                listed = [k.tolist() if w else [] for k, w in zip(keys.view(np.int64), s.n_words, strict=True)]
                own = [b.column(c).slice(s.rows.start, n) for c in ("doc_id", *shared.KEY)]
                whole = [pa.array(_whole(s, w, i).view(np.int64)) for i, w in enumerate((words, s.word_hashes(True)))]
                arrays = [*own, *whole, pa.array(listed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *shared.KEY, "h1", "h2", "bands"])

    return run


def _whole(s: Slice, words: np.ndarray, second: int) -> np.ndarray:
    """Hash of each row's words in order."""
    seed = np.uint64(1 + second)
    place = np.arange(len(words)) - s.first[s.row_of_word]
    salted = mix(words ^ mix((place.astype(np.uint64) + seed) * _G))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(salted, out=sums[1:])
    return mix(sums[s.first[1:]] - sums[s.first[:-1]] + s.n_words.astype(np.uint64) * seed)


def _multisets(size: int):
    """v, its shingles as sorted distinct values, the n-th of a kind made distinct by n, and how many are in each of CELLS ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                row, value = shingles(s, s.word_hashes(), size)
                first = _distinct(row, value)
                nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                value = mix(value + nth.astype(np.uint64) * _G)
                order = np.lexsort((value, row))
                cut = np.searchsorted(row, np.arange(len(s.rows) + 1))
                held = [value[order[a:z]].tobytes() for a, z in zip(cut, cut[1:], strict=False)]
                cell = row * CELLS + (value >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
                cells = np.minimum(np.bincount(cell, minlength=len(s.rows) * CELLS), MANY).astype(np.uint8).reshape(-1, CELLS)
                own = b.column("v").slice(s.rows.start, len(s.rows))
                yield pa.RecordBatch.from_arrays([own, pa.array(held, pa.binary()), pa.array([c.tobytes() for c in cells], pa.binary())], ["v", "bag", "cells"])

    return run


def _may_be_alike(p: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Whether counts by cell (row x cell) leave it open that the similarity is ``least`` or more."""
    both, sizes = np.minimum(p, q).sum(axis=1, dtype=np.int64), p.sum(axis=1, dtype=np.int64) + q.sum(axis=1, dtype=np.int64)
    return ((p == MANY) | (q == MANY)).any(axis=1) | (both >= least * (sizes - both) - 1e-9)


def _possible(pairs: DataFrame, least: float) -> DataFrame:
    """Those of pairs (v, w, cells_v, cells_w) that may be alike, each once, as a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, CELLS) for c in ("cells_v", "cells_w"))
            yield b.select(["v", "w"]).filter(pa.array(_may_be_alike(p, q, least), pa.bool_()))

    found = pairs.select("v", "w", "cells_v", "cells_w").mapInArrow(run, "v long, w long")
    return found.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("bag_a"), b.column("bag_b"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = min(len(p), len(q)), max(len(p), len(q))
                if small < least * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (small + large - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b; a written table) that are alike. A vertex of many pairs is dealt over several tasks, by its partners."""
    counts = {x: _counted(pairs, x) for x in ("a", "b")}
    for x, partner in (("a", "b"), ("b", "a")):
        held = bags.select(F.col("v").alias(x), F.col("bag").alias(f"bag_{x}"))
        pairs = shared.dealt(pairs, held, [x], counts[x], by=F.xxhash64(partner))
    return pairs.select("a", "b", "bag_a", "bag_b").mapInArrow(_similar(least), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """v and root, the least vertex of its component, for the vertices of links (a, b).

    In each round a vertex takes the least label of its neighbours, and then the label of its label; links
    are then told by labels, each once, so that fewer vertices and links are left for the next. Labels of
    all rounds are followed at the end.
    """
    left, rounds = shared.written(links.where("a != b").select("a", "b").distinct()), []
    while left.limit(1).count():
        forth, back = (left.select(F.col(x).alias("v"), F.col(y).alias("w")) for x, y in ("ab", "ba"))
        first = forth.unionByName(back).groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("root"))
        first = shared.written(first)
        ends = first.select(F.col("v").alias("root"), F.col("root").alias("r_root"))
        labels = shared.dealt(first, ends, ["root"], _counted(first, "root"))
        labels = shared.written(labels.select("v", F.least("root", "r_root").alias("root")))
        rounds.append(labels)
        for x, y in ("ab", "ba"):
            named = labels.select(F.col("v").alias(x), F.col("root").alias(f"{x}_root"))
            left = shared.dealt(left, named, [x], _counted(left, x), by=F.xxhash64(y))
        left = left.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a != b")
        left = shared.written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return links.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)
    roots = rounds[-1]
    for labels in reversed(rounds[:-1]):
        onward = roots.select(F.col("v").alias("root"), F.col("root").alias("r_root"))
        met = shared.dealt(labels, onward, ["root"], _counted(labels, "root"), "left")
        roots = shared.written(met.select("v", F.coalesce("r_root", "root").alias("root")))
    return roots


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """band, v, cells, root and n (members) of the buckets whose members are of more than one component."""
    placed = members.select("band", "v", "cells").join(roots, "v", "left")
    placed = shared.written(placed.select("band", "v", "cells", F.coalesce("root", "v").alias("root")))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    mixed = shared.written(mixed.where("lo != hi").select("band", "n"))
    return shared.dealt(placed, mixed, ["band"], mixed)


def _hub_pairs(open_: DataFrame, t: int, least: float) -> DataFrame:
    """Pairs (a < b) of some members of each bucket, picked by hash, with its members of other components, that may be alike."""
    places = range(t * HUBS, t * HUBS + HUBS)
    picked = open_.groupBy("band").agg(
        *(F.min(F.struct(F.xxhash64("v", F.lit(j)), "v", "root", "cells")).alias(f"h{j}") for j in places),
        F.count(F.lit(1)).alias("n"),
    )
    hub = [F.struct(F.col(f"h{j}.v").alias("hub"), F.col(f"h{j}.root").alias("hub_root"), F.col(f"h{j}.cells").alias("hub_cells")) for j in places]
    hubs = shared.written(picked.select("band", "n", F.array_distinct(F.array(*hub)).alias("hubs")))
    met = shared.dealt(open_.drop("n"), hubs.drop("n"), ["band"], hubs)
    met = met.select("v", "cells", F.explode(F.expr("filter(hubs, h -> h.hub_root != root)")).alias("h"))
    return _possible(met.select("v", F.col("h.hub").alias("w"), F.col("cells").alias("cells_v"), F.col("h.hub_cells").alias("cells_w")), least)


def _frequent(bags: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of bags, sorted, and the number of bags that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, n = np.unique(np.frombuffer(b"".join(b.column("bag").to_pylist()), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["value", "n"])

    counts = bags.select("bag").mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "value").limit(RANKED).toArrow()
    value, n = got.column("value").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy().astype(np.int64)
    order = np.argsort(value)
    return value[order], n[order]


def _prefixes(least: float, common: np.ndarray, frequency: np.ndarray):
    """v, root, cells, n (size of the bag) and its first shingles, rare ones first, with their places; first: whether the place counts for the smaller bag of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, root, n, value, place, first, row = [], [], [], [], [], [], []
            for v_, root_, bag in zip(b.column("v").to_pylist(), b.column("root").to_pylist(), b.column("bag"), strict=True):
                x = np.frombuffer(bag.as_py(), np.uint64)
                often = np.zeros(len(x), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    often = np.where(common[at] == x, frequency[at], 0)
                # alike bags have at least least x n shingles in common, the smaller one 2 least / (1 + least) x n
                probe, index = (len(x) - int(np.ceil(share * len(x) - 1e-6)) + 1 for share in (least, 2 * least / (1 + least)))
                taken = np.lexsort((x, often))[:probe]
                k = len(taken)
                v.append(np.full(k, v_)), root.append(np.full(k, root_)), n.append(np.full(k, len(x))), value.append(x[taken]), place.append(np.arange(k)), first.append(np.arange(k) < index), row.append(np.full(k, len(row)))
            if v:
                cols = [np.concatenate(c) for c in (v, root, n, value, place, first)]
                cols[3] = cols[3].view(np.int64)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 5 + (pa.bool_(),), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, b.column("cells").take(pa.array(np.concatenate(row)))], ["v", "root", "n", "value", "place", "first", "cells"])

    return run


def _prefix_pairs(bags: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of bags (v, root, bag, cells) of different roots that hold every pair of similarity ``least`` or more.

    With all shingles in one order, rare ones first, the first shingle that two
    alike bags have in common stands early in both, and enough follow it in
    both. The order only decides how many other pairs come along.
    """
    p = shared.written(bags.mapInArrow(_prefixes(least, *_frequent(bags)), "v long, root long, n long, value long, place long, first boolean, cells binary"))
    met = p.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi")
    met = shared.written(met.select("value", "n", F.ceil(F.sqrt("n") / 8).cast("int").alias("parts")))
    # the members of a shingle are met in several parts if they are many
    p = shared.dealt(p, met.select("value", "parts"), ["value"], met, by=F.xxhash64("v"))
    short = p.where("first").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("s")
    long_ = p.withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).alias("l")
    sized = (F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.v") < F.col("l.v")))
    enough = F.least(F.col("s.n") - F.col("s.place"), F.col("l.n") - F.col("l.place")) >= (F.col("s.n") + F.col("l.n")) * (least / (1 + least)) - 1e-6
    on = (F.col("s.value") == F.col("l.value")) & (F.col("s.part") == F.col("l.part")) & (F.col("s.root") != F.col("l.root")) & sized & (F.col("s.n") >= F.col("l.n") * least - 1e-6) & enough
    pairs = short.join(long_, on).select(F.col("s.v").alias("v"), F.col("l.v").alias("w"), F.col("s.cells").alias("cells_v"), F.col("l.cells").alias("cells_w"))
    return _possible(pairs, least)


def _bags(rows: DataFrame, wanted: DataFrame, sigs: DataFrame, size: int) -> DataFrame:
    """v, bag and cells of the vertices wanted (v and the key of one of its rows; a written table)."""
    key = list(shared.KEY)
    if shared.few(wanted):
        found = rows.join(F.broadcast(wanted), key)
    else:
        repeats = sigs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        found = shared.dealt(rows, wanted, key, repeats)
    return found.groupBy("v").agg(F.first("text").alias("text")).mapInArrow(_multisets(size), "v long, bag binary, cells binary")


def _alike(members: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """root of each vertex that has a link: the components of all alike members (band, v, cells, hub, hub_cells) of common buckets."""
    written = shared.written
    first = members.where("v != hub").select("v", F.col("hub").alias("w"), F.col("cells").alias("cells_v"), F.col("hub_cells").alias("cells_w"))
    pairs = written(_possible(first, least))
    links = written(_verified(pairs, bags, least))
    roots = components(links)
    for t in range(HUB_ROUNDS):
        open_ = written(_open(members, roots))
        if not open_.limit(1).count():
            return roots
        fresh = _hub_pairs(open_, t, least).join(pairs, ["a", "b"], "left_anti")
        more = written(_verified(written(fresh), bags, least))
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        roots = components(links)
    open_ = written(_open(members, roots))
    small = open_.where(F.col("n") <= SMALL)
    left, right = (small.select("band", F.col("v").alias(x), F.col("root").alias(f"root_{x}"), F.col("cells").alias(f"cells_{x}")) for x in ("v", "w"))
    # within components nothing is left to find, so only pairs between two of them are made
    across = _possible(left.join(right, "band").where("v < w and root_v != root_w"), least)
    wide = written(open_.where(F.col("n") > SMALL).select("v", "root").distinct())
    if wide.limit(1).count():
        across = across.unionByName(_prefix_pairs(written(bags.join(shared.hinted(wide), "v")), least))
    across = written(across.distinct().join(pairs, ["a", "b"], "left_anti"))
    more = written(_verified(across, bags, least))
    return components(links.unionByName(more)) if more.limit(1).count() else roots


def near_groups(
    docs: DataFrame, least: float = 0.8, size: int = SHINGLE, n_bands: int = BANDS, n_rows: int = ROWS
) -> DataFrame:
    """doc_id, class_id, class_size, kept, key and key2 (of the row, by doc_id and text), one row for each row of docs.

    The kept row has doc_id class_id; its repeated rows are marked too.
    """
    key, written = list(shared.KEY), shared.written
    with shared.Scratch(docs.sparkSession) as tables:
        rows = docs.select("doc_id", shared.body().alias("text"), *shared.row_key())
        schema = "doc_id long, key long, key2 long, h1 long, h2 long, bands array<long>"
        sigs = written(rows.mapInArrow(_signed(size, n_bands, n_rows), schema))
        one = sigs.groupBy("h1", "h2").agg(
            F.min(F.struct(*key)).alias("row"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")
        )
        vertices = written(one.select("h1", "h2", "row.*", "bands", "n", F.monotonically_increasing_id().alias("v")))
        buckets = vertices.select("v", F.explode("bands").alias("band"))
        sizes = written(_counted(buckets, "band").where("n > 1"))
        members = written(shared.dealt(buckets, sizes, ["band"], sizes))
        wanted = written(vertices.select("v", *key).join(members.select("v").distinct(), "v"))
        bags = written(_bags(rows, wanted, sigs, size))
        # one vertex is the hub of as many buckets as can be, so that a vertex meets few hubs
        reach = members.groupBy("v").agg(F.sum("n").alias("reach"))
        members = written(members.drop("n").join(reach, "v").join(bags.select("v", "cells"), "v"))
        hub = F.max(F.struct("reach", (-F.col("v")).alias("back"), F.col("v").alias("hub"), F.col("cells").alias("hub_cells"))).alias("h")
        hubs = members.groupBy("band").agg(hub).select("band", "h.hub", "h.hub_cells")
        members = written(shared.dealt(members.drop("reach"), hubs, ["band"], sizes))
        roots = _alike(members, bags, least)
        rooted = vertices.join(roots, "v", "left").select("h1", "h2", F.coalesce("root", "v").alias("root"), "n")
        rooted = written(rooted)
        told = shared.dealt(sigs.drop("bands"), rooted.drop("n"), ["h1", "h2"], rooted)
        told = tables.keep(told.select("doc_id", *key, "root"))
        first = F.struct(F.isnull("doc_id").alias("none"), "doc_id", *key)
        classes = told.groupBy("root").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("n"))
        classes = tables.keep(classes)
    kept = (F.col("key") == F.col("best.key")) & (F.col("key2") == F.col("best.key2"))
    out = shared.dealt(told, classes, ["root"], classes)
    return out.select(
        "doc_id", F.col("best.doc_id").alias("class_id"), F.col("n").alias("class_size"), kept.alias("kept"), *key
    )


def near_deduplicated(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs of which one for each class stays; columns as in docs."""
    with shared.Scratch(docs.sparkSession) as tables:
        told = tables.keep(near_groups(docs, least).select(*shared.KEY, "kept"))
    return shared.only_kept(docs, told)
