"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda of symbol pairs.

A text is cut where no piece of the vocabulary can reach across: before runs of
the space symbol and of such marks as follow no letter in any piece, and around
what no piece joins to anything. Merges on either side of such a cut cannot meet, so each part is encoded alone, once for
every time it enters a bounded store of parts. Within a part the agenda holds each
pair of adjacent symbols that together are a piece; the pair of greatest score,
then furthest left, is merged, and the pairs it makes with its neighbours come in.

Parts are encoded in Arrow batches, and with ``check`` those that enter the store
are encoded by the sentencepiece library too; a difference ends the job. Memory: a
batch of texts, some ten times the longest text, and at most 2 x STORE parts.

Cases: a null text counts as empty and has the end id alone; every row gives one
row, repeated ones too; doc_id may be null; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provara.llm import shared

SPACE = "▁"
#: Texts are taken so many characters at a time; parts that one generation of the store holds.
SLICE, STORE = 1 << 20, 300_000
#: Parts of so many letters keep their agenda in a list, longer ones in a heap.
SHORT, NONE = 24, float("-inf")
#: Longer parts are cut once more, at pairs of letters that stand side by side in no piece.
LONG = 64

# fixed values of the vocabulary format: kinds of model and of pieces, and the text of an unknown piece
BPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_TEXT = " ⁇ "


@dataclass
class Vocabulary:
    """Pieces with their ids and scores."""

    ids: dict[str, int]
    scores: dict[str, float]
    texts: list[str | None]  # by id: a normal piece's text, None for bytes, unknown and control pieces
    bytes_: dict[int, int]  # value of the byte piece of an id
    byte_ids: list[int]  # id by value, empty without byte pieces
    unknown: int
    end: int
    dummy_prefix: bool
    bare_model: bytes  # the model as a file holds it, but that it puts no space first

    def __post_init__(self) -> None:
        self.shown = [(t or "").replace(SPACE, " ") for t in self.texts]
        self.shown[self.unknown] = UNKNOWN_TEXT
        for at in self.bytes_:
            self.shown[at] = None  # bytes show together with those beside them
        several = [p for p in self.scores if len(p) > 1]
        self.joined = {p[i : i + 2] for p in several for i in range(len(p) - 1)}
        known = set("".join(several))
        low = {chr(c) for c in range(128)}
        alone = low - known  # no piece joins them to anything
        first = not any(pair[1] == SPACE != pair[0] for pair in self.joined)  # a space symbol follows nothing but itself
        marks = {c for c in (low | known) - alone - {SPACE} if not (c.isalpha() or c.isdecimal())} | ({SPACE} if not first else set())
        bound = {b for a, b in self.joined if b in marks and a not in marks | {SPACE}}  # those that some letter may precede
        one, free, tied = (re.escape("".join(sorted(x))) for x in (alone, marks - bound, bound))
        letter, mark = f"[^{one}{free}{tied}{SPACE if first else ''}]", f"[{free}{tied}]"
        # a part ends where a letter stands before a free mark
        again = f"(?:{letter}+[{tied}]{mark}*)*{letter}*" if bound else f"{letter}*"
        inner = f"(?:{mark}+{again}|{letter}{again})" if marks else f"{letter}+"
        kinds = [f"{SPACE}*{inner}", f"{SPACE}+"] if first else [inner]
        pattern = "|".join(kinds + ([f"[{one}]"] if alone else []))
        self.parts: Callable[[str], list[str]] = re.compile(pattern, re.S).findall

    def escaped(self, text: str) -> str:
        """The text as symbols: spaces escaped, and one put first."""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def merged(self, part: str) -> list[str]:
        """The symbols left when no two adjacent ones make a piece."""
        return self._by_heap(part) if len(part) > SHORT else self._by_list(part)

    def _by_list(self, part: str) -> list[str]:
        """The agenda of a short part is a list in order of places: the greatest score found first is the one furthest left."""
        symbols, score = list(part), self.scores.get
        agenda = [score(a + b, NONE) for a, b in pairwise(symbols)]
        while agenda and (best := max(agenda)) != NONE:
            i = agenda.index(best)
            symbols[i : i + 2] = (symbols[i] + symbols[i + 1],)
            del agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], NONE)
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], NONE)
        return symbols

    def _by_heap(self, part: str) -> list[str]:
        scores, n = self.scores, len(part)
        ends = list(range(1, n + 1))  # of the symbol that starts at a place, 0 within symbols
        starts = list(range(n))  # of the symbol that ends before place + 1
        agenda = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := scores.get(part[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, middle, j = heapq.heappop(agenda)
            if ends[i] != middle or ends[middle] != j:
                continue  # one of the two has been merged since
            ends[i], ends[middle], starts[j - 1] = j, 0, i
            if i and (s := scores.get(part[(left := starts[i - 1]) : j])) is not None:
                heapq.heappush(agenda, (-s, left, i, j))
            if j < n and (s := scores.get(part[i : (right := ends[j])])) is not None:
                heapq.heappush(agenda, (-s, i, j, right))
        out, i = [], 0
        while i < n:
            out.append(part[i : ends[i]])
            i = ends[i]
        return out

    def part_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for run in self._runs(part) if len(part) > LONG else (part,):
            for symbol in self.merged(run):
                if (at := self.ids.get(symbol)) is not None:
                    out.append(at)
                elif self.byte_ids:
                    out += [self.byte_ids[b] for b in symbol.encode()]
                else:
                    out.append(self.unknown)
        return out

    def _runs(self, part: str) -> Iterator[str]:
        a = 0
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in self.joined:
                yield part[a:i]
                a = i
        yield part[a:]

    def encode(self, text: str) -> list[int]:
        """Ids of the text, with the end id."""
        return [x for part in self.parts(self.escaped(text)) for x in self.part_ids(part)] + [self.end]

    def plain(self, ids: list[int]) -> str:
        """The text of ids, with the space put first still in it."""
        shown = [self.shown[x] for x in ids]
        if None not in shown:
            return "".join(shown)
        out, held = [], bytearray()
        for x in [*ids, None]:
            if x in self.bytes_:
                held.append(self.bytes_[x])
                continue
            if held:
                out.append(_from_bytes(bytes(held)))
                held.clear()
            if x is not None:
                out.append(self.shown[x])
        return "".join(out)

    def prefixed(self, first: int | None) -> bool:
        """Whether a text whose first id that shows is this one begins with the space put first."""
        return self.dummy_prefix and first is not None and (self.texts[first] or "").startswith(SPACE)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 give a replacement mark each."""
        shown = (x for x in ids if x == self.unknown or x in self.bytes_ or self.texts[x] is not None)
        return self.plain(ids)[self.prefixed(next(shown, None)) :]


def _from_bytes(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


def vocabulary(path: str) -> Vocabulary:
    """Reads a model file on the driver; the executors get its bytes and tables.

    ValueError for models that are not of merge type, change letters or spaces before they
    encode, or have pieces that the user defined or took out of use.
    """
    from sentencepiece import sentencepiece_model_pb2 as format_

    m = format_.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if m.trainer_spec.model_type != BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError(f"{path}: only merge-type models that take letters and spaces as they are")
    if not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only models that escape spaces and put them first")
    if {p.type for p in m.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"{path}: has pieces that the user defined or took out of use")
    dummy_prefix, spec.add_dummy_prefix = spec.add_dummy_prefix, False
    numbered = list(enumerate(m.pieces))
    byte_of = {at: int(p.piece[1:-1], 16) for at, p in numbered if p.type == BYTE}
    by_value = {v: at for at, v in byte_of.items()}
    return Vocabulary(
        ids={p.piece: at for at, p in numbered if p.type == NORMAL},
        scores={p.piece: p.score for at, p in numbered if p.type == NORMAL},
        texts=[p.piece if p.type == NORMAL else None for p in m.pieces],
        bytes_=byte_of,
        byte_ids=[by_value[v] for v in range(256)] if len(by_value) == 256 and m.trainer_spec.byte_fallback else [],
        unknown=next(at for at, p in numbered if p.type == UNKNOWN),
        end=next(at for at, p in numbered if p.type == CONTROL and p.piece == m.trainer_spec.eos_piece),
        dummy_prefix=dummy_prefix,
        bare_model=m.SerializeToString(),
    )


class _Store:
    """Ids and text of the parts met lately, in two generations of at most STORE parts and one slice's."""

    def __init__(self, words: Vocabulary, check: bool):
        self.words, self.library = words, None
        self.new: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=words.bare_model)

    def take(self, wanted: set[str]) -> dict[str, tuple[bytes, str]]:
        """The store, with all the parts wanted in it."""
        if len(self.new) > STORE:
            self.old, self.new = self.new, {}
        fresh = []
        for part in wanted - self.new.keys():
            if (known := self.old.get(part)) is not None:
                self.new[part] = known
            else:
                fresh.append(part)
        ids = [self.words.part_ids(part) for part in fresh]
        plain = [self.words.plain(x) for x in ids]
        if self.library and fresh:
            theirs = self.library.encode(fresh, num_threads=1)
            for part, own, other in zip(fresh, ids, theirs, strict=True):
                if own != other:
                    raise ValueError(f"{part!r} is encoded as {own}, by the library as {other}")
        self.new.update(zip(fresh, ((array("i", x).tobytes(), t) for x, t in zip(ids, plain, strict=True)), strict=True))
        return self.new


def _encoded(words: Vocabulary, check: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([words.end], np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Store(words, check)
        for b in batches:
            texts, a = b.column("text").to_pylist(), 0
            while a < len(texts):
                z, held = a, 0
                while z < len(texts) and (z == a or held + len(texts[z]) <= SLICE):
                    held += len(texts[z])
                    z += 1
                cut = [words.parts(words.escaped(t)) for t in texts[a:z]]
                known = store.take(set().union(*cut)).__getitem__
                ids, plain = [], []
                for parts in cut:
                    found = [known(p) for p in parts]
                    ids.append(b"".join([x[0] for x in found]) + end)
                    plain.append("".join([x[1] for x in found])[words.prefixed(int.from_bytes(ids[-1][:4], sys.byteorder)) :])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), lists, pa.array(plain, pa.string())], ["doc_id", "ids", "decoded"])
                a = z

    return run


def encoded(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """doc_id, ids (with the end id) and decoded (the text of those ids), one row for each row of docs."""
    words = vocabulary(model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", shared.body().alias("text")).mapInArrow(
        _encoded(words, check), f"doc_id {kind}, ids array<int>, decoded string"
    )
