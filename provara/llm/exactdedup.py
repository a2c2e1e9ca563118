"""Exact dedup with counting quotient filters.

Each task folds the 64-bit fingerprints of its rows into counting quotient
filters, one for each range of fingerprints (their top bits). Within a range the
next bits are the quotient, which is not stored but told by the slot: a bitmap
marks the quotients in use and another the slot in which each one's run of
remainders ends; remainders stand in whole bytes, and counts above one in
counters of their own beside a bitmap of the slots that have them. Filters of one
range merge without loss: their runs are read back in order, merged by sorted
remainders, and counts are added. Fingerprints whose count is above one route
their rows to byte verification against the first row of their group; all other
rows are unique and never shuffled.

Two texts are equal when identical after every character of [\\x20\\x09-\\x0D] is
deleted; null counts as empty. Of equal texts the row with most code points,
then smallest doc_id stays (null doc_id last). Of repeated rows alike in both,
one stays and the others are dropped. A text is never cut: a task needs some
four times the bytes of its longest text. Columns of docs besides doc_id and text
are not looked at and may have any name. An empty table gives no rows.

A hot group is dealt over as many salted tasks as its filter count asks for,
each with its own copy of the one text compared against, and is summed up
before it is shuffled. Fingerprints to look up are broadcast only while they
number at most shared.BROADCAST_ROWS; beyond that the lookup is a shuffled join
that deals hot fingerprints over several tasks too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provara.llm import shared

_DELETE = shared.SPACES.encode()
#: Rows of a hot group that are compared in one task.
SALT_ROWS = 2000
#: Fingerprints that a task holds before it emits its filters.
UNIT = 1 << 20


def bare(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _DELETE)


def fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").view(bool)


class CountingQuotientFilter:
    """A multiset of fingerprints that have their top ``bits`` in common.

    slots: number of distinct fingerprints; q: bits of the quotient, so that there are about as many quotients
    as slots. occupied: bitmap over quotients; run_end, repeated: bitmaps over slots; remainders: slots x bytes;
    counters: the counts above one, in slot order.
    """

    def __init__(self, top: int, bits: int, slots: int, occupied: bytes, run_end: bytes, remainders: bytes, repeated: bytes, counters: bytes):
        self.top, self.bits, self.slots = top, bits, slots
        self.occupied, self.run_end, self.remainders = occupied, run_end, remainders
        self.repeated, self.counters = repeated, counters

    @staticmethod
    def _quotient_bits(slots: int, bits: int) -> int:
        return min(max(slots - 1, 1).bit_length(), 63 - bits)

    @classmethod
    def of(cls, top: int, bits: int, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From sorted distinct fingerprints and their counts."""
        n = len(fingerprints)
        q = cls._quotient_bits(n, bits)
        low = fingerprints & np.uint64((1 << (64 - bits)) - 1)
        quotient = (low >> np.uint64(64 - bits - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_end = np.ones(n, bool)
        run_end[:-1] = quotient[1:] != quotient[:-1]
        width = -(-(64 - bits - q) // 8)
        remainder = low & np.uint64((1 << (64 - bits - q)) - 1)
        bytes_ = np.ascontiguousarray(remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width])
        repeated = counts > 1
        held = counts[repeated].astype(np.int64).tobytes()
        return cls(top, bits, n, _bits(occupied), _bits(run_end), bytes_.tobytes(), _bits(repeated), held)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and counts."""
        n, q = self.slots, self._quotient_bits(self.slots, self.bits)
        width = -(-(64 - self.bits - q) // 8)
        used = np.flatnonzero(_flags(self.occupied, 1 << q)).astype(np.uint64)
        ends = _flags(self.run_end, n)
        run = np.cumsum(ends) - ends
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(self.remainders, np.uint8).reshape(n, width)
        fingerprints = used[run] << np.uint64(64 - self.bits - q) | wide.view("<u8").ravel()
        if self.bits:
            fingerprints |= np.uint64(self.top << (64 - self.bits))
        counts = np.ones(n, np.int64)
        counts[_flags(self.repeated, n)] = np.frombuffer(self.counters, np.int64)
        return fingerprints, counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter of all the fingerprints of filters of one range."""
        parts = [f.items() for f in filters]
        fingerprints, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(fingerprints, kind="stable")
        fingerprints, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]]))
        return cls.of(filters[0].top, filters[0].bits, fingerprints[first], np.add.reduceat(counts, first))


def filters_of(hashes: np.ndarray, bits: int) -> Iterator[CountingQuotientFilter]:
    """A filter for each range that the fingerprints fall in."""
    fingerprints, counts = np.unique(hashes, return_counts=True)
    top = (fingerprints >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fingerprints), np.int64)
    used, first = np.unique(top, return_index=True)
    for t, a, z in zip(used, first, [*first[1:], len(top)], strict=True):
        yield CountingQuotientFilter.of(int(t), bits, fingerprints[a:z], counts[a:z])


_PARTS = ("occupied", "run_end", "remainders", "repeated", "counters")


def repeated_fingerprints(docs: DataFrame) -> DataFrame:
    """fp and n of the fingerprints that more than one row has, by merged filters."""
    bits = min(30, max(4, (shared.n_inputs(docs) * 4).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []

        def emitted() -> pa.RecordBatch:
            found = list(filters_of(np.array(hashes, np.uint64), bits))
            hashes.clear()
            numbers = [pa.array([f.top for f in found], pa.int64()), pa.array([f.slots for f in found], pa.int64())]
            parts = [pa.array([getattr(f, p) for f in found], pa.binary()) for p in _PARTS]
            return pa.RecordBatch.from_arrays(numbers + parts, ["top", "slots", *_PARTS])

        for b in batches:
            hashes += [fingerprint(bare(t.as_py())) for t in b.column("text")]
            if len(hashes) >= UNIT:
                yield emitted()
        if hashes:
            yield emitted()

    def merge(group: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter(bits=bits, **r) for r in group.to_pylist()]
        fingerprints, counts = CountingQuotientFilter.merged(filters).items()
        many = counts > 1
        return pa.table({"fp": pa.array(fingerprints[many].view(np.int64)), "n": pa.array(counts[many])})

    schema = "top long, slots long, " + ", ".join(f"{p} binary" for p in _PARTS)
    return docs.select("text").mapInArrow(build, schema).groupBy("top").applyInArrow(merge, "fp long, n long")


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, key of the row, n_cp, fp, text_sha256 and the bare bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            bytes_ = [bare(t) for t in texts]
            made = {
                "n_cp": pa.array([len(t or "") for t in texts], pa.int64()),
                "fp": pa.array(np.array([fingerprint(x) for x in bytes_], np.uint64).view(np.int64)),
                "text_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in bytes_], pa.string()),
                "bare": pa.array(bytes_, pa.binary()),
            }
            own = ["doc_id", *shared.KEY]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *made.values()], [*own, *made])

    schema = "doc_id long, key long, key2 long, n_cp long, fp long, text_sha256 string, bare binary"
    return docs.select("doc_id", "text", *shared.row_key()).mapInArrow(run, schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, key and key2 (of the row, by doc_id and text), one row for each row of docs."""
    key, written = list(shared.KEY), shared.written
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), salts - 1))
    with shared.Scratch(docs.sparkSession) as tables:
        found = tables.keep(repeated_fingerprints(docs))
        rows = _measured(docs)
        if shared.few(found):
            looked = F.broadcast(found)
            alone, met = rows.join(looked.select("fp"), "fp", "left_anti"), rows.join(looked, "fp")
        else:
            alone = shared.dealt(rows, found.select("fp"), ["fp"], found, "left_anti")
            met = shared.dealt(rows, found, ["fp"], found)
        # rid tells repeated rows apart; the table is written, so it is the same wherever it is read
        many = met.withColumn("rid", F.monotonically_increasing_id())
        many = written(many.withColumn("salt", F.pmod(F.xxhash64("rid"), salts).cast("int")))
        first = many.groupBy("fp").agg(F.min("rid").alias("rid")).select("rid")
        heads = many.join(first, "rid", "left_semi")
        heads = heads.select("fp", F.col("bare").alias("head"), every.alias("salt"))
        # a text unlike its group's first (two texts of one fingerprint) is told apart by its digest
        variant = F.when(F.col("bare") == F.col("head"), F.lit("")).otherwise(F.col("text_sha256"))
        verified = many.join(heads, ["fp", "salt"])
        verified = tables.keep(verified.select("doc_id", *key, "n_cp", "rid", "fp", "n", "salt", "text_sha256", variant.alias("variant")))
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    best = verified.groupBy("fp", "variant").agg(
        F.min(F.struct(-F.col("n_cp"), last, F.isnull("doc_id"), "rid", "doc_id")).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
        F.first("n").alias("n"),
    )
    best = best.withColumn("salt", every).drop("n")
    dealt = verified.drop("n").join(best, ["fp", "salt", "variant"])
    out = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", *key)
    dealt = dealt.withColumns({"keep_id": F.col("best.doc_id"), "kept": F.col("rid") == F.col("best.rid")})
    one = {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    return alone.withColumns(one).select(*out).unionByName(dealt.select(*out))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay; columns as in docs."""
    with shared.Scratch(docs.sparkSession) as tables:
        told = tables.keep(exact_groups(docs).select(*shared.KEY, "kept"))
    return shared.only_kept(docs, told)
