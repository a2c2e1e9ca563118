"""Substring dedup by difference-cover anchors.

D is a difference cover modulo PERIOD: for any two positions i and j some d <
PERIOD puts both i + d and j + d at positions in D modulo PERIOD. So of two
equal windows of ``window`` words, wherever they stand, some equal windows of
window - PERIOD + 1 words begin at cover positions. Only those anchors, under a
quarter of all positions, are hashed and shuffled; each window that holds an
anchor found elsewhere is then extended: hashed in full (128 bits) and counted.

Before a shuffle each task counts what it holds itself, so a passage of any
frequency is sent once a task; what a task has twice is known to repeat and
only tells others. Ranges of hashes are merged as sorted arrays.

A text that several rows have is searched once: all windows of such rows repeat,
so they lose all words, unless they have fewer than ``window``. So no row key is
hot. Texts are told apart by 128 bits, windows by two hashes of 64 bits over the
128-bit hashes of their words; words are not compared again.

Null texts have no words. Repeated rows are rows of one text. Texts under
``window`` words lose none. A text is never cut, so a task needs some thirty
times the bytes of its longest text. Of docs only doc_id and text are read, so
other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provara.llm import shared
from provara.llm.arrowtext import mix, ranges, slices, window_hashes, within

PERIOD, COVER = 21, (0, 1, 4, 14, 16)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Windows that a task holds before it sends them.
UNIT = 1 << 20

_SENT = "rng int, told boolean, h1 binary, h2 binary, key binary, pos binary"
_PARTS = "rng int, key binary, pos binary"
_FOUND = "key long, key2 long, pos binary"

#: Key of a text: the two longs of shared.KEY.
_KEY = np.dtype([("a", "<i8"), ("b", "<i8")])

Windows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # h1, h2, key of the text, position


def _keys(b: pa.RecordBatch) -> np.ndarray:
    out = np.empty(b.num_rows, _KEY)
    out["a"], out["b"] = b.column("key").to_numpy(), b.column("key2").to_numpy()
    return out


def _spread(keys: np.ndarray) -> np.ndarray:
    """Hash by which keys are dealt over ranges."""
    return mix(np.ascontiguousarray(keys["a"]).view(np.uint64))


def _cut(order_by: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """range, start, end of each run of equal top bits of sorted hashes."""
    top = (order_by >> np.uint64(64 - bits)).astype(np.int64)
    used, first = np.unique(top, return_index=True)
    if not len(used):
        return []
    return [(int(q), int(a), int(z)) for q, a, z in zip(used, first, [*first[1:], len(top)], strict=True)]


def _grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, whether each in that order has an equal, and whether it is the first of its equals."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    last = np.ones(len(a), bool)
    last[:-1] = new[1:]
    return order, ~(new & last), new


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


def _sent(parts: list[Windows], bits: int) -> pa.RecordBatch:
    """A unit's windows by range.

    Those that it has once ask for an answer. Of those that it has twice one goes along (position -1), and all
    are reported as found (told).
    """
    h1, h2, key, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, twice, new = _grouped(h1, h2)
    h1, h2, key, pos = h1[order], h2[order], key[order], pos[order]
    asked = [x[new] for x in (h1, h2, key, np.where(twice, -1, pos).astype(np.int32))]
    rows = [(q, False, *(x[a:z].tobytes() for x in asked)) for q, a, z in _cut(asked[0], bits)]
    if twice.any():
        key, pos = key[twice], pos[twice].astype(np.int32)
        spread = _spread(key)
        o = np.argsort(spread, kind="stable")
        rows += [(q, True, b"", b"", key[o[a:z]].tobytes(), pos[o[a:z]].tobytes()) for q, a, z in _cut(spread[o], bits)]
    names = ["rng", "told", "h1", "h2", "key", "pos"]
    return _table(rows, names, [pa.int32(), pa.bool_(), *[pa.binary()] * 4]).combine_chunks().to_batches()[0]


def _answered(bits: int) -> Callable[[pa.Table], pa.Table]:
    """Of one range of hashes: texts and positions of the windows that stand in more than one place, by range of the keys."""

    def joined(group: pa.Table, column: str, kind: np.dtype | type, told: bool) -> np.ndarray:
        picked = group.column(column).filter(pc.equal(group.column("told"), told))
        return np.frombuffer(b"".join(picked.to_pylist()), kind)

    def run(group: pa.Table) -> pa.Table:
        keys, places = joined(group, "key", _KEY, True), joined(group, "pos", np.int32, True)
        h1, h2 = joined(group, "h1", np.uint64, False), joined(group, "h2", np.uint64, False)
        if len(h1):
            order, twice, _ = _grouped(h1, h2)
            k, p = joined(group, "key", _KEY, False)[order], joined(group, "pos", np.int32, False)[order]
            keep = twice & (p >= 0)
            keys, places = np.concatenate([keys, k[keep]]), np.concatenate([places, p[keep]])
        spread = _spread(keys)
        o = np.argsort(spread, kind="stable")
        rows = [(q, keys[o[a:z]].tobytes(), places[o[a:z]].tobytes()) for q, a, z in _cut(spread[o], bits)]
        return _table(rows, ["rng", "key", "pos"], [pa.int32(), pa.binary(), pa.binary()])

    return run


def _by_text(group: pa.Table) -> pa.Table:
    """Of one range of keys: the positions of each."""
    keys = np.frombuffer(b"".join(group.column("key").to_pylist()), _KEY)
    places = np.frombuffer(b"".join(group.column("pos").to_pylist()), np.int32)
    order = np.lexsort((keys["b"], keys["a"]))
    keys, places = keys[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    pos = [places[a:z].tobytes() for a, z in zip(first, [*first[1:], len(keys)], strict=True)] if len(keys) else []
    cols = {"key": pa.array(keys["a"][first]), "key2": pa.array(keys["b"][first]), "pos": pa.array(pos, pa.binary())}
    return pa.table(cols)


def _repeats(rows: DataFrame, windows: Callable[[pa.RecordBatch], Iterator[Windows]], bits: int) -> DataFrame:
    """key, key2 and pos (int32 positions) of the windows that repeat anywhere, one row for each text of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for w in windows(b):
                if len(w[0]):
                    held.append(w)
                    n += len(w[0])
                if n >= UNIT:
                    yield _sent(held, bits)
                    held, n = [], 0
        if n:
            yield _sent(held, bits)

    answers = rows.mapInArrow(run, _SENT).groupBy("rng").applyInArrow(_answered(bits), _PARTS)
    return answers.groupBy("rng").applyInArrow(_by_text, _FOUND)


def _anchors(window: int) -> Callable[[pa.RecordBatch], Iterator[Windows]]:
    size = window - PERIOD + 1

    def run(b: pa.RecordBatch) -> Iterator[Windows]:
        keys = _keys(b)
        for s in slices(b.column("text")):
            hashes = window_hashes(s.word_hashes(), size)
            long_ = s.n_words >= window
            at = ranges(s.first[:-1], np.where(long_, s.n_words - size + 1, 0))
            row = np.searchsorted(s.first, at, "right") - 1
            local = at - s.first[row]
            cover = _IN_COVER[local % PERIOD]
            at, row, local = at[cover], row[cover], local[cover]
            yield hashes[at], np.zeros(len(at), np.uint64), keys[s.rows.start : s.rows.stop][row], local

    return run


def _positions(places: pa.Array, rows: range, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row in the slice and word in the slice of all positions."""
    each = [np.frombuffer(p, np.int32) for p in places.slice(rows.start, len(rows)).to_pylist()]
    row = np.repeat(np.arange(len(rows)), [len(p) for p in each])
    return row, first[row] + np.concatenate(each).astype(np.int64)


def _extended(window: int) -> Callable[[pa.RecordBatch], Iterator[Windows]]:
    def run(b: pa.RecordBatch) -> Iterator[Windows]:
        keys = _keys(b)
        for s in slices(b.column("text")):
            row, anchor = _positions(b.column("pos"), s.rows, s.first)
            change = np.zeros(int(s.first[-1]) + 2, np.int64)
            np.add.at(change, np.maximum(s.first[row], anchor - PERIOD + 1), 1)
            np.add.at(change, anchor + 1, -1)
            at = within(s.first, window)
            at = at[np.cumsum(change)[at] > 0]
            row = np.searchsorted(s.first, at, "right") - 1
            one, two = window_hashes(s.word_hashes(), window), window_hashes(s.word_hashes(second=True), window)
            yield one[at], two[at], keys[s.rows.start : s.rows.stop][row], at - s.first[row]

    return run


def _result(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], [], [], []]
            told = (b.column(c).to_pylist() for c in ("text", "pos", "again"))
            for text, places, again in zip(*told, strict=True):
                words = text.encode().split()  # bytes split at exactly the contract's white space
                kept = words
                if again and len(words) >= window:
                    kept = []
                elif places:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.frombuffer(places, np.int32)
                    np.add.at(change, at, 1)
                    np.add.at(change, np.minimum(at + window, len(words)), -1)
                    keep = np.cumsum(change)[:-1] == 0
                    kept = [w for w, k in zip(words, keep, strict=True) if k]
                joined = b" ".join(kept)
                row = (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode())
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Those of distinct texts that are found, with what was found; only they are shuffled while the keys may be broadcast."""
    keys = found.select(*shared.KEY)
    texts = texts.join(F.broadcast(keys), list(shared.KEY), "left_semi") if shared.few(keys) else texts
    return texts.join(found, list(shared.KEY))


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space), one row for each row of docs.

    window is at least PERIOD + 1.
    """
    key, schema = list(shared.KEY), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    bits = min(24, max(4, (shared.n_inputs(docs) * 2).bit_length()))
    with shared.Scratch(docs.sparkSession) as tables:
        rows = docs.select("doc_id", shared.body().alias("text"), *shared.text_key())
        counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        counts = tables.keep(counts)
        if shared.few(counts):
            several = F.broadcast(counts.select(*key))
            alone, copies = rows.join(several, key, "left_anti"), rows.join(several, key, "left_semi")
        else:
            alone = shared.dealt(rows, counts, key, counts, "left_anti")
            copies = shared.dealt(rows, counts, key, counts)
        one_each = shared.written(copies.groupBy(*key).agg(F.first("text").alias("text")))
        texts = alone.select(*key, "text").unionByName(one_each)
        anchored = shared.written(_repeats(texts, _anchors(window), bits))
        repeated = tables.keep(_repeats(_of(texts, anchored), _extended(window), bits))
    keys = repeated.select(*key)
    none = F.lit(None).cast("binary").alias("pos")
    whole = alone.join(shared.hinted(keys), key, "left_anti").select("doc_id", "text", none, F.lit(False).alias("again"))
    again = copies.select("doc_id", "text", none, F.lit(True).alias("again"))
    cut = _of(alone, repeated).select("doc_id", "text", "pos", F.lit(False).alias("again"))
    simple = whole.unionByName(again).mapInArrow(_result(window), schema)
    return simple.unionByName(cut.mapInArrow(_result(window), schema))
