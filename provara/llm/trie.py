"""Prefix tries of conversations from partial tries that partitions make and a hash-keyed tree of merges joins.

Turns are reduced to 128 bits of SHA-256 over role and text and their code points,
dealt by range of (conversation, turn), so that one conversation may span any number
of tasks, and checkpointed: both passes see the same partitions. The first pass folds
each partition into a few numbers; the driver chains those (one row a partition) and
so tells each partition where it starts. In the second pass every partition builds
the tries of its own conversations and emits a locally combined node table: a node is
known by a polynomial over its turns' bits modulo 2**127 - 1, which can be carried on
at any turn. Node tables are merged FAN at a time, keyed by node, until one is left.

Of the merged nodes only those with several members have anything to add up: the
rollup gives each the sums of its descendants, bottom up, over distances of 1, 2, 4,
... links, so that a trie of any depth takes logarithmically many steps. End lists
are merged as sorted blocks that no row has to hold together; the digest of a node's
list is streamed through one task, as SHA-256 has to.

Cases: rows without conv_id are left out; a null turn comes first, equal turns are in
order of their SHA-256, repeated rows are turns of their own; null role or text is
empty; a conversation without turns left ends at the root; conv_id % 100 and its
base are taken as the floor for negative ids; other columns are not read; an empty
table gives no rows. Memory: NODES nodes of one task, and one block of ids a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provara.llm import shared

#: The polynomial's modulus and base, and the root's value.
PRIME, BASE, ROOT = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F, 1
#: Nodes that a task combines before it emits them, and tables that one merge joins.
NODES, FAN = 100_000, 64
#: Turns that a conversation may take over are fewer than this, and ids in blocks of so many share them.
SHARED, BLOCK = 6, 100

NODE = ("k1", "k2")
_PARTIAL = "part int, k1 long, k2 long, p1 long, p2 long, depth long, chars long, conv_id long, n_convs long, ends array<long>"


def _taken_over(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % SHARED


def _base(conv: int) -> int:
    return conv - conv % BLOCK


def _onward(at: int, turn: int) -> int:
    return (at * BASE + turn) % PRIME


def _halves(node: int) -> tuple[int, int]:
    low = node & (1 << 64) - 1
    return node >> 64, low - (1 << 64) if low >> 63 else low


@dataclass
class _Summary:
    """What a partition tells of its last conversation and of the turns that others of its block may take over."""

    first: int
    last: int
    turns: int = 0  # of the last conversation
    after: list[int] = field(default_factory=lambda: [0] * SHARED)  # value of those turns but for the first 0, 1, ... of them
    head: list[tuple[int, int]] = field(default_factory=list)  # first turns of the block's base

    def add(self, conv: int, turn: int, chars: int) -> None:
        if conv != self.last:
            if _base(conv) != _base(self.last):
                self.head = []
            self.last, self.turns, self.after = conv, 0, [0] * SHARED
        if conv == _base(conv) and len(self.head) < SHARED - 1:
            self.head.append((turn, chars))
        for skipped in range(min(self.turns + 1, SHARED)):
            self.after[skipped] = _onward(self.after[skipped], turn)
        self.turns += 1


@dataclass
class _Place:
    """Where a scan of all turns stands: the conversation, its own turns seen, and the node reached."""

    conv: int | None = None
    seen: int = 0
    depth: int = 0
    node: int = ROOT
    head: list[tuple[int, int]] = field(default_factory=list)

    def own_from(self) -> int:
        """Turns of the conversation itself that count from here on start at this one."""
        return 0 if self.conv == _base(self.conv) else _taken_over(self.conv)

    def borrowed(self) -> list[tuple[int, int]]:
        return self.head[: self.own_from()]

    def opened(self, conv: int) -> _Place:
        """At the start of a conversation, before the turns that it takes over."""
        same = self.conv is not None and _base(self.conv) == _base(conv)
        return _Place(conv, head=list(self.head) if same else [])

    def after(self, s: _Summary) -> _Place:
        """Behind the partition that s tells of."""
        now = self
        if self.conv is not None and _base(self.conv) == _base(s.last):
            # the base's turns come first in its block: all are in sight by now
            head = (self.head + s.head)[: SHARED - 1]
        else:
            head = s.head
        if self.conv != s.last:
            now = _Place(s.last, head=head)
            for turn, _ in now.borrowed():
                now.node, now.depth = _onward(now.node, turn), now.depth + 1
        dropped = min(s.turns, max(0, now.own_from() - now.seen))
        kept = s.turns - dropped
        node = (now.node * pow(BASE, kept, PRIME) + s.after[dropped]) % PRIME if kept else now.node
        return _Place(s.last, now.seen + s.turns, now.depth + kept, node, head)


def _turns(b: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    for conv, turn, chars in zip(b.column("conv_id").to_pylist(), b.column("digest").to_pylist(), b.column("chars").to_pylist(), strict=True):
        yield conv, int.from_bytes(turn) % PRIME, chars


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = part = None
    for b in batches:
        for conv, turn, chars in _turns(b):
            if s is None:
                s, part = _Summary(conv, conv), b.column("part")[0].as_py()
            s.add(conv, turn, chars)
    if s:
        told = [part, s.first, s.last, s.turns, [x.to_bytes(16) for x in s.after], [x.to_bytes(16) for x, _ in s.head], [n for _, n in s.head]]
        yield pa.RecordBatch.from_pylist([dict(zip(_SUMMARY.names, told, strict=True))], schema=_SUMMARY)


_SUMMARY = pa.schema([
    ("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("turns", pa.int64()),
    ("after", pa.list_(pa.binary())), ("head", pa.list_(pa.binary())), ("head_chars", pa.list_(pa.int64())),
])


class _Partial:
    """A node table of the conversations seen since it was last emitted."""

    def __init__(self, part: int):
        self.part, self.nodes = part, {}

    def member(self, node: int, parent: int | None, depth: int, chars: int, conv: int) -> None:
        if (held := self.nodes.get(node)) is None:
            self.nodes[node] = [parent, depth, chars, conv, 1, []]
        else:
            held[4] += 1

    def end(self, node: int, depth: int, conv: int) -> None:
        # a conversation that began in an earlier partition may end at a node this one has no member of
        self.nodes.setdefault(node, [None, depth, None, conv, 0, []])[5].append(conv)

    def emitted(self) -> Iterator[pa.RecordBatch]:
        rows = []
        for node, (parent, depth, chars, conv, n, ends) in self.nodes.items():
            p1, p2 = (None, None) if parent is None else _halves(parent)
            rows.append((self.part, *_halves(node), p1, p2, depth, chars, conv, n, ends))
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
        self.nodes = {}


_FIELDS = [(n, pa.int32() if t == "int" else pa.list_(pa.int64()) if t.startswith("array") else pa.int64()) for n, t in (c.split() for c in _PARTIAL.split(", "))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _partial_tries(places: dict[int, tuple[_Place, bool]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """places: for each partition with rows where it starts, and whether its last conversation goes on in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = trie = None
        goes_on = False
        for b in batches:
            for conv, turn, chars in _turns(b):
                if at is None:
                    part = b.column("part")[0].as_py()
                    (at, goes_on), trie = places[part], _Partial(part)
                    started = at.conv == conv
                else:
                    started = True
                if conv != at.conv:
                    if started:
                        trie.end(at.node, at.depth, at.conv)
                    at = at.opened(conv)
                    trie.member(ROOT, None, 0, 0, conv)
                    for borrowed, n in at.borrowed():
                        _step(at, trie, borrowed, n)
                if conv == _base(conv) and len(at.head) < SHARED - 1:
                    at.head.append((turn, chars))
                if at.seen >= at.own_from():
                    _step(at, trie, turn, chars)
                at.seen += 1
            if trie and len(trie.nodes) >= NODES:
                yield from trie.emitted()
        if trie:
            if not goes_on:
                trie.end(at.node, at.depth, at.conv)
            yield from trie.emitted()

    return run


def _step(at: _Place, trie: _Partial, turn: int, chars: int) -> None:
    parent, at.node, at.depth = at.node, _onward(at.node, turn), at.depth + 1
    trie.member(at.node, parent, at.depth, chars, at.conv)


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, digest, chars and part (the partition), in order and checkpointed."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("digest")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest, F.length(text).cast("long").alias("chars"))
    # repeated rows are dealt too
    small = shared.written(rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())))
    order = ("conv_id", "turn", "digest", "spread")
    placed = small.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", "digest", "chars", F.spark_partition_id().alias("part"))
    shared.with_checkpoints(small.sparkSession)
    return placed.checkpoint()


def _partials(turns: DataFrame) -> DataFrame:
    ordered = _ordered(turns)
    told = ordered.mapInArrow(_summarised, "part int, first long, last long, turns long, after array<binary>, head array<binary>, head_chars array<long>")
    rows = sorted(told.collect(), key=lambda r: r.part)  # one a partition
    place, places = _Place(), {}
    for row, next_ in zip(rows, [*rows[1:], None], strict=False):
        places[row.part] = place, next_ is not None and next_.first == row.last
        head = [(int.from_bytes(x), n) for x, n in zip(row.head, row.head_chars, strict=True)]
        place = place.after(_Summary(row.first, row.last, row.turns, [int.from_bytes(x) for x in row.after], head))
    return ordered.mapInArrow(_partial_tries(places), _PARTIAL)


def merged(partials: DataFrame) -> DataFrame:
    """k1, k2, p1, p2, depth, chars, conv_id and n_convs, one row a node: FAN node tables are summed at a time."""
    last = partials.agg(F.max("part")).first()[0] or 0
    level, groups = partials.drop("ends"), last + 1
    while True:
        groups = -(-groups // FAN)
        level = level.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(*NODE, "part").agg(
            *(F.max(c).alias(c) for c in ("p1", "p2", "depth", "chars")), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")
        )
        if groups == 1:
            return level.drop("part")


def rolled(nodes: DataFrame) -> DataFrame:
    """k1, k2 and the sums of leaves and saved over each node's subtree, for nodes that have them and their parent.

    After step i each node has the sums of its descendants within 2**i links and knows its ancestor at that
    distance, to which the next step adds them.
    """
    level = shared.written(nodes.select(*NODE, F.col("p1").alias("a1"), F.col("p2").alias("a2"), "leaves", "saved"))
    while level.where("a1 is not null").limit(1).count():
        sums = level.where("a1 is not null").groupBy("a1", "a2").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("n"))
        sums = shared.written(sums)
        above = sums.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "more", "more_saved")
        added = level.join(above, list(NODE), "left").select(
            *NODE, "a1", "a2",
            (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        further = level.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        met = shared.dealt(shared.written(added), further, ["a1", "a2"], sums, "left")
        level = shared.written(met.select(*NODE, F.col("b1").alias("a1"), F.col("b2").alias("a2"), "leaves", "saved"))
    return level.select(*NODE, "leaves", "saved")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids; rows are sorted by node and first id."""
    node, digest = None, None
    for b in batches:
        out = []
        for k1, k2, ends in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("ends"), strict=True):
            if node != (k1, k2):
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, ends.as_py())).encode())
        if out:
            yield _digest_batch(out)
    if node:
        yield _digest_batch([(*node, digest.hexdigest())])


def _digest_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    k1, k2, ends = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ends)], ["k1", "k2", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    with shared.Scratch(turns.sparkSession) as tables:
        partials = shared.written(_partials(turns))
        nodes = tables.keep(merged(partials))
        children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("tails")
        )
        children = tables.keep(children)
        # a node of one member has one leaf below it and saves nothing, nor do its descendants
        several = shared.written(nodes.where("n_convs > 1 or depth = 0"))
        saved = (F.col("n_convs") - 1) * F.col("chars")
        leaves = F.coalesce("tails", F.lit(0)) + F.isnull("n_children").cast("long")
        own = several.join(children, list(NODE), "left").select(*NODE, "p1", "p2", leaves.alias("leaves"), saved.alias("saved"))
        sums = tables.keep(rolled(own))
        ends = partials.where(F.size("ends") > 0).select(*NODE, "ends", F.col("ends")[0].alias("first"))
        ends = ends.repartition(*NODE).sortWithinPartitions(*NODE, "first").drop("first")
        ends = tables.keep(ends.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string"))
        parents = tables.keep(several.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent")))
        told = nodes.join(children.drop("tails"), list(NODE), "left").join(sums, list(NODE), "left").join(ends, list(NODE), "left")
        told = tables.keep(told)
        if shared.few(parents):
            met = told.join(F.broadcast(parents), ["p1", "p2"], "left")
        else:
            counted = children.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n_children").alias("n"))
            met = shared.dealt(told, parents, ["p1", "p2"], counted, "left")
    # the parent of a node that is not among those of several members has the same one
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    none = F.sha2(F.lit(""), 256)
    return met.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
