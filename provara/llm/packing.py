"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` words.

Documents longer than a bin are cut: full pieces have a bin each, the rest is
packed. Rows are dealt by hash into shards of bounded words and rows; within a
shard, pieces by falling size go each to the compatible bin of least sufficient
residual. Bins are kept by residual; the search takes the successor of the size
among residuals in use, and goes on to the next bin, then the next residual,
until one is compatible, else opens a bin.

A bin is compatible if its bitmaps allow the piece: it has no other document of
the same duplicate cluster, and fewer than ``lanes`` documents of its source.
The cluster is a given column, or the text without white space. Shards have bins
of their own, so no conflict crosses them. What a bin holds only grows, so a bin
passed over for a source and cluster is never looked at again for them while it
keeps its residual: equal texts cost no more steps than there are bins.

Null and empty texts hold no words: they go into the tightest bin without lane or
cluster. Each repeated row is packed; being one cluster, they land in different
bins. Rows are numbered by their content, so another split of the input gives the
same bins. Pieces of one size are placed by doc_id (null first), then hash of the
text. A null source is a source of its own. Texts are counted by a pattern, so a
long one needs no more than its bytes. Of docs only doc_id, source, text and
``cluster`` are read, so other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provara.llm import shared
from provara.llm.mixing import words

CAPACITY = 2048
LANES = 4
SHARD_WORDS, SHARD_ROWS = 4_000_000, 20_000


class Bins:
    """Bins by residual, with one bitmap of source lanes and one of clusters each."""

    def __init__(self, capacity: int, lanes: int):
        self.capacity, self.lanes = capacity, lanes
        # bins in the order in which they came to each residual; a bin that has left stays as an entry to skip
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.held = [0] * (capacity + 1)
        self.used = 0  # bit r: some bin has residual r
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        # residual, source, cluster -> entries that have left or can never take such a piece
        self.passed: dict[tuple[int, int, int], int] = {}

    def place(self, size: int, source: int, cluster: int | None) -> int:
        """Bin of a piece: the first of least sufficient residual that is compatible, else a new one."""
        lanes = ((1 << self.lanes) - 1) << (source * self.lanes) if size else 0
        mark = 0 if cluster is None or not size else 1 << cluster
        kind = -1 if not mark else cluster
        rest, r = self.used >> size, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r, rest = r + step, rest >> step
            at = self.at[r]
            i = max(self.passed.get((r, source, kind), 0), self.passed.get((r, source, -1), 0))
            while i < len(at):
                b = at[i]
                if self.residual[b] == r and not self.clusters[b] & mark and (not size or self.sources[b] & lanes != lanes):
                    break
                i += 1
            if size:
                self.passed[r, source, kind] = i
            if i < len(at):
                if size:
                    self.held[r] -= 1
                    if not self.held[r]:
                        self.used &= ~(1 << r)
                    self._put(at[i], r - size, lanes, mark)
                return at[i]
            r, rest = r + 1, rest >> 1
        self.residual.append(-1), self.sources.append(0), self.clusters.append(0)
        self._put(len(self.residual) - 1, self.capacity - size, lanes, mark)
        return len(self.residual) - 1

    def _put(self, b: int, residual: int, lanes: int, mark: int) -> None:
        free = lanes & ~self.sources[b]
        self.sources[b] |= free & -free
        self.clusters[b] |= mark
        self.residual[b] = residual
        self.at[residual].append(b)
        self.held[residual] += 1
        self.used |= 1 << residual


def best_fit(pieces: list[tuple[int, object, object]], capacity: int, lanes: int) -> list[int]:
    """Bin of each (size, source, cluster), placed by falling size, ties in the order given."""
    seen: dict[object, int] = {}
    for _, _, c in pieces:
        seen[c] = seen.get(c, 0) + 1
    index = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    sources: dict[object, int] = {}
    bins, out = Bins(capacity, lanes), [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        size, source, cluster = pieces[i]
        out[i] = bins.place(size, sources.setdefault(source, len(sources)), index.get(cluster))
    return out


_OUT = "doc_id long, piece long, first_word long, n_words long, bin_id string"


def packed(docs: DataFrame, capacity: int = CAPACITY, lanes: int = LANES, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, first_word, n_words and bin_id: one row for each piece of each row of docs."""
    bare = F.translate(shared.body(), shared.SPACES, "")
    own = F.col(f"`{cluster}`").cast("string") if cluster else F.xxhash64(bare).cast("string")
    units = docs.select("doc_id", "source", words().alias("size"), own.alias("cluster"), *shared.text_key())
    units = units.groupBy("doc_id", "source", "size", "cluster", *shared.KEY).agg(F.count(F.lit(1)).alias("n"))
    with shared.Scratch(docs.sparkSession) as tables:
        rows = tables.keep(shared.repeated(units, "n").drop("n"))
    rest_size = F.col("size") % capacity
    total = rows.agg(F.sum(rest_size), F.count(F.lit(1))).first()
    shards = max(1, -(-(total[0] or 0) // SHARD_WORDS), -(-total[1] // SHARD_ROWS))
    full = rows.withColumn("n_full", F.floor(F.col("size") / capacity))
    full = shared.repeated(full, "n_full", "piece")
    name = F.concat_ws("-", F.lit("full"), "doc_id", F.hex("key"), F.hex("key2"), "source", "repeat", "piece")
    first = (F.col("piece") * F.lit(capacity)).cast("long")
    whole = F.lit(capacity).cast("long").alias("n_words")
    full = full.select("doc_id", "piece", first.alias("first_word"), whole, name.alias("bin_id"))
    shard = F.pmod(F.xxhash64("doc_id", *shared.KEY, "source", "repeat"), F.lit(shards))
    rest = rows.where((rest_size > 0) | (F.col("size") == 0)).withColumn("shard", shard)

    def pack(group: pa.Table) -> pa.Table:
        order = [("doc_id", "ascending"), *((k, "ascending") for k in shared.KEY), ("source", "ascending"), ("repeat", "ascending")]
        d = group.sort_by(order).to_pydict()
        sizes = d["size"]
        bins = best_fit(list(zip([s % capacity for s in sizes], d["source"], d["cluster"], strict=True)), capacity, lanes)
        columns = (
            d["doc_id"],
            [s // capacity for s in sizes],
            [s // capacity * capacity for s in sizes],
            [s % capacity for s in sizes],
            [f"{d['shard'][0]}-{b}" for b in bins],
        )
        types = (*[pa.int64()] * 4, pa.string())
        names = ("doc_id", "piece", "first_word", "n_words", "bin_id")
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return full.unionByName(rest.groupBy("shard").applyInArrow(pack, _OUT))
