"""Personal data: base patterns, then a skip-chain conditional random field.

The base finds e-mails, IPv4 addresses, card numbers and phone numbers by the
patterns below. The field then labels every candidate token (a run outside
[\\x20\\x09-\\x0D] that has a digit or an @; all other tokens are O by definition)
as O, email, ip, card or phone:

- unary potentials from the token's shape and the base span that covers it;
- chain potentials between neighbouring tokens;
- skip potentials between tokens of the same document, however distant, that
  are alike: equal digits (seven or more, or the last seven of them), or equal
  letters of an e-mail's local part.

Loopy sum-product passing gives marginals; a token that no base span covers and
whose most likely label is not O becomes a further span, so one mention in
plain form labels the others. Base spans always stay, so the label of a token in
one is known: each other token alike to it, however far, takes it in directly,
as often as there are such tokens. The other alike tokens are linked in a chain
in text order, so work grows with tokens, not with their squares. Messages are
passed until they settle (or 500 times, if they never do).

Weights are fitted here once, by pseudo-likelihood on a fixed generated sample
of labelled token lines, and travel with the task.

Null texts count as empty and have no spans. Repeated rows give equal results. An
empty table gives no rows. Equally likely labels: the first of O, email, ip, card,
phone. Of the row only the text is read, so other columns may have any name. A
text is never cut: beside its bytes a task holds its candidate tokens, some 1 KB each.
Entities written out in words are never found, as their tokens are no candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Digits that make a number of several parts a whole one, and most digits of one.
NUMBERS = {"phone": (7, 15), "card": (13, 19)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, since runs are taken whole
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^ \t-\r]+")
_HINT = re.compile(r"[0-9@]")
_TRIM = ".,;:!?\"'<>[]{}()|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches that do not overlap, of each kind; those that fail their test are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not _HINT.search(text):
        return found
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found["email"].append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


@dataclass
class Token:
    start: int
    end: int
    text: str
    index: int  # of the token among all of the text
    base: int  # label of the base span that covers part of it, or 0


def tokens(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[Token]:
    """Candidate tokens without outer marks."""
    covers = sorted((s, e, LABELS.index(k)) for k, found in spans.items() for s, e in found)
    out: list[Token] = []
    c, position, seen = 0, 0, 0
    for hint in _HINT.finditer(text):
        if hint.start() < seen:
            continue
        start = hint.start()
        while start > seen and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        m = _TOKEN.match(text, start)
        gap = text[seen:start]
        position += len(gap.split()) if gap.strip() else 0
        seen = m.end()
        bare = m[0].strip(_TRIM)
        if bare and _HINT.search(bare):
            a = start + m[0].index(bare)
            z = a + len(bare)
            while c < len(covers) and covers[c][1] <= a:
                c += 1
            base, i = 0, c
            while not base and i < len(covers) and covers[i][0] < z:
                base = covers[i][2] if covers[i][1] > a else 0
                i += 1
            out.append(Token(a, z, bare, position, base))
        position += 1
    return out


def unary(t: Token, last: bool, next_: bool) -> list[int]:
    """Features in force; last, next_: whether the neighbouring token is a candidate too."""
    n = sum("0" <= c <= "9" for c in t.text)
    rest = len(t.text) - n
    size = 0 if n < 3 else 1 if n < 5 else 2 if n < 9 else 3 if n < 13 else 4 if n < 20 else 5
    shape = 0 if rest == 0 else 1 if set(t.text) <= set("0123456789.") else 2 if set(t.text) <= set("0123456789+()-") else 3 if "@" in t.text else 4
    return [0, 1 + t.base, 6 + size, 12 + shape, 17 + 6 * shape + size, 47 + last, 49 + next_]


N_UNARY = 51


def links(ts: list[Token]) -> list[tuple[int, int]]:
    """Pairs of alike tokens: each with the next of its likeness."""
    by: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(ts):
        d = _digits(t.text)
        if "@" in t.text:
            by["@" + t.text.split("@")[0].lower()].append(i)
        elif any(c.isalpha() for c in t.text):
            by["@" + t.text.lower()].append(i)
        elif len(d) >= 7:
            by[d[-7:]].append(i)
            if len(d) > 7:
                by["=" + d].append(i)
    return sorted({(a, b) for group in by.values() for a, b in zip(group, group[1:], strict=False)})


def known(ts: list[Token]) -> np.ndarray:
    """Token x label: how many tokens in base spans of the label each other token is alike to."""
    by: dict[str, np.ndarray] = {}
    keys = []
    for t in ts:
        d = _digits(t.text)
        # equal digits are equal in the last seven too
        keys.append("@" + t.text.split("@")[0].lower() if "@" in t.text else "@" + t.text.lower() if any(c.isalpha() for c in t.text) else d[-7:] if len(d) >= 7 else None)
        if t.base and keys[-1]:
            by.setdefault(keys[-1], np.zeros(len(LABELS)))[t.base] += 1
    nothing = np.zeros(len(LABELS))
    return np.array([nothing if t.base or k is None else by.get(k, nothing) for t, k in zip(ts, keys, strict=True)])


def chains(ts: list[Token]) -> list[tuple[int, int]]:
    return [(i, i + 1) for i in range(len(ts) - 1) if ts[i + 1].index == ts[i].index + 1]


@dataclass(frozen=True)
class Field:
    unary: np.ndarray  # feature x label
    chain: np.ndarray  # label x label
    skip: np.ndarray  # label x label

    def marginals(self, ts: list[Token], rounds: int = 500, settled: float = 1e-6) -> np.ndarray:
        near = chains(ts)
        far = links([t for t in ts if not t.base])
        place = [i for i, t in enumerate(ts) if not t.base]
        far = [(place[a], place[b]) for a, b in far]
        joined = {a for a, _ in near}, {b for _, b in near}
        own = np.array([self.unary[unary(t, i in joined[1], i in joined[0])].sum(axis=0) for i, t in enumerate(ts)]) + known(ts) @ self.skip
        own = np.exp(np.maximum(own - own.max(axis=1, keepdims=True), -500))
        for i, t in enumerate(ts):
            if t.base:  # what is known is no variable: its neighbours hear of this label alone
                own[i] = 1e-12
                own[i, t.base] = 1.0
        edges = [(a, b, np.exp(self.chain)) for a, b in near] + [(a, b, np.exp(self.skip)) for a, b in far]
        if not edges:
            return own / own.sum(axis=1, keepdims=True)
        a, b = (np.array([e[i] for e in edges]) for i in (0, 1))
        there, back = np.stack([e[2] for e in edges]), np.stack([e[2].T for e in edges])
        src, dst, pot = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([there, back])
        m, other = np.ones((len(src), len(LABELS))) / len(LABELS), np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        for _ in range(rounds):
            logs = np.log(own)
            np.add.at(logs, dst, np.log(m))
            held = logs[src] - np.log(m[other])
            held = np.exp(held - held.max(axis=1, keepdims=True))
            new = np.einsum("el,elk->ek", held, pot)
            was, m = m, np.maximum(0.5 * m + 0.5 * new / new.sum(axis=1, keepdims=True), 1e-12)
            if np.abs(m - was).max() < settled:
                break
        logs = np.log(own)
        np.add.at(logs, dst, np.log(m))
        out = np.exp(logs - logs.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def _sample(n: int = 600, seed: int = 5) -> Iterator[tuple[list[Token], np.ndarray]]:
    """Generated lines with their true labels: entities in plain form, the same again in other forms, and numbers that are none."""
    r = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    for _ in range(n):
        words: list[tuple[str, int]] = []
        for _ in range(int(r.integers(1, 5))):
            kind = int(r.integers(0, 9))
            if kind == 0:
                name = "u" + digits(2) + "n"
                words += [(f"{name}@mail{digits(1)}.example.com", 1)] + ([("and", 0), (f"{name}@mail", 1)] if r.random() < 0.5 else [])
            elif kind == 1:
                ip = ".".join(str(x) for x in r.integers(0, 256, 4))
                words += [(ip, 2), ("or", 0)] + ([(ip, 2)] if r.random() < 0.4 else [])
            elif kind == 2:
                body = digits(15)
                card = next(body + str(c) for c in range(10) if luhn(body + str(c)))
                words += [(card, 3), ("or", 0)] + ([(card[:4] + "." + card[4:8] + "." + card[8:12] + "." + card[12:], 3)] if r.random() < 0.6 else [])
            elif kind in (3, 4):
                a, b, c = digits(3), digits(3), digits(4)
                words += [("+1", 4), (f"({a})", 4), (f"{b}-{c}", 4), ("or", 0)] + ([(f"{a}-{b}-{c}", 4)] if r.random() < 0.6 else [(f"{b}-{c}", 4)] if r.random() < 0.3 else [])
            else:
                number = (digits(int(r.integers(1, 20))), f"{digits(2)}.{digits(2)}", f"x{digits(6)}f", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(3)}-{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}")[int(r.integers(0, 6))]
                words += [(number, 0), ("or", 0)] * int(r.integers(1, 3))
            words.append(("of", 0))
        text, labels, at = "", {}, 0
        for w, lab in words:
            labels[len(text)] = lab
            text += w + " "
        ts = tokens(text, base_spans(text))
        true = []
        for t in ts:
            at = text.rfind(" ", 0, t.start) + 1
            lab = labels[at]
            true.append(0 if lab == 3 and not t.base and not any(abs(t.start - o.start) > 1 and o.base == 3 and _digits(o.text) == _digits(t.text) for o in ts) else lab)
        if ts:
            yield ts, np.array(true)


@lru_cache(1)
def fitted(rounds: int = 150) -> Field:
    """The field's weights by pseudo-likelihood: each token given its neighbours' true labels."""
    k = len(LABELS)
    x, y, around = [], [], []
    for ts, true in _sample():
        near, far = chains(ts), links(ts)
        joined = {a for a, _ in near}, {b for _, b in near}
        for i, t in enumerate(ts):
            row = np.zeros(N_UNARY)
            row[unary(t, i in joined[1], i in joined[0])] = 1
            edge = np.zeros((3, k))
            for a, b in near:
                if a == i:
                    edge[0, true[b]] += 1
                if b == i:
                    edge[1, true[a]] += 1
            for a, b in far:
                if i in (a, b):
                    edge[2, true[b if a == i else a]] += 1
            x.append(row), y.append(true[i]), around.append(edge)
    x, y, around = np.array(x), np.array(y), np.array(around)
    u, c, s = np.zeros((N_UNARY, k)), np.zeros((k, k)), np.zeros((k, k))
    speed = [np.full(w.shape, 1e-6) for w in (u, c, s)]
    for _ in range(rounds):
        z = x @ u + around[:, 0] @ c.T + around[:, 1] @ c + around[:, 2] @ s
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        e = p / len(y)
        grads = (x.T @ e + 1e-4 * u, e.T @ around[:, 0] + around[:, 1].T @ e + 1e-4 * c, around[:, 2].T @ e + 1e-4 * s)
        for w, g, v in zip((u, c, s), grads, speed, strict=True):
            v += g * g
            w -= 0.5 * g / np.sqrt(v)
    return Field(u, c, (s + s.T) / 2)


def _same_mention(kind: str, before: str, part: str) -> bool:
    """Whether a part that follows others of its kind goes on with them: they are no whole number yet, and it makes none too long."""
    if kind not in NUMBERS:
        return False
    whole, most = NUMBERS[kind]
    return len(_digits(before)) < whole and len(_digits(before)) + len(_digits(part)) <= most


def find(text: str | None, field: Field, sure: float = 0.8) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and the spans that the field adds (label of at least ``sure``)."""
    text = text or ""
    base = base_spans(text)
    more: list[tuple[str, int, int]] = []
    if _HINT.search(text) and (ts := tokens(text, base)):
        p = field.marginals(ts)
        best = p.argmax(axis=1)
        for i, t in enumerate(ts):
            if best[i] and not t.base and p[i, best[i]] >= sure:
                kind = LABELS[best[i]]
                beside = more and more[-1][0] == kind and ts[i - 1].index == t.index - 1 and more[-1][2] == ts[i - 1].end
                if beside and _same_mention(kind, text[more[-1][1] : more[-1][2]], t.text):
                    more[-1] = (kind, more[-1][1], t.end)
                else:
                    more.append((kind, t.start, t.end))
    return base, more


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def personal_data(text: Column) -> Column:
    """struct of arrays base and added, each of struct(kind, start, end) in code points, end exclusive, and the digest of the base spans."""
    span = "array<struct<kind: string, start: int, end: int>>"
    field = fitted()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(f"struct<base: {span}, added: {span}, base_sha256: string, spans: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            bases, adds, shas, alls = [], [], [], []
            for t in texts:
                base, more = find(t.as_py(), field)
                flat = [(k, s, e) for k in KINDS for s, e in base[k]]
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in flat])
                adds.append([{"kind": k, "start": s, "end": e} for k, s, e in more])
                shas.append(hashlib.sha256(joined(flat).encode()).hexdigest())
                alls.append(joined(flat + more))
            yield pa.StructArray.from_arrays([pa.array(bases, kind), pa.array(adds, kind), pa.array(shas, pa.string()), pa.array(alls, pa.string())], ["base", "added", "base_sha256", "spans"])

    return run(text)
