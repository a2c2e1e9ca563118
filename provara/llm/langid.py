"""Language ID by multilingual mixture inference.

Training counts hashed byte trigrams of lower-case letter runs (with word
edges) for each language over every training document; tasks add up dense
blocks of counts, which are summed by language and block. Only that model,
languages x 2**16 numbers, reaches the driver: its size is set by the labels
in use, not by the corpus.

A word's likelihood under a language is the product of its trigrams'. For each
document expectation-maximisation estimates the proportions of all languages,
then sets of the languages of largest proportion are compared by likelihood
less 0.5 * languages * log(words), and the set of the best value is selected.
The prediction is the selected language of largest proportion; on ties the
first by code point.

Each expectation-maximisation runs until no proportion moves by SETTLED, at most
ROUNDS rounds. How far the likelihood reached may be below the greatest one is
bounded (the likelihood is concave in the proportions), and with that bound sets
of languages are ruled out.

Null texts and texts without a letter are ``und`` with score 0. With no
training document every text is ``und``. Repeated rows give equal results, and an
empty table no rows. Texts are taken in slices, but one text is never cut: a task
needs some forty times the bytes of its longest text. Columns of docs besides
those replaced stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provara.llm.arrowtext import _NO_LETTER, SLICE_BYTES, Slice, seeded, slices

BITS, BLOCK = 16, 1024
#: Rounds of expectation-maximisation at most, and the change of a proportion at which it ends.
ROUNDS, SETTLED = 200, 1e-4
_A, _B, _C = seeded(256, 11), seeded(256, 12), seeded(256, 13)
# digits of other kinds (superscripts, fractions) match too
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def grams(s: Slice) -> np.ndarray:
    """Bucket of the trigram around each letter byte, in order."""
    mask = ~_NO_LETTER[s.data]
    z = np.where(mask, s.data, 0)
    before, after = np.zeros_like(z), np.zeros_like(z)
    before[1:], after[:-1] = z[:-1], z[1:]
    inner = s.offsets[(s.offsets > 0) & (s.offsets < len(z))]
    before[inner], after[inner - 1] = 0, 0
    return ((_A[before] ^ _B[z] ^ _C[after])[mask] >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # bucket x language: log-probabilities

    def word_likelihoods(self, s: Slice) -> np.ndarray:
        """word x language, each row divided by its largest, at least 1e-9."""
        per_gram = self.table[grams(s)]
        lengths = s.ends - s.starts
        total = np.add.reduceat(per_gram, np.cumsum(lengths) - lengths, axis=0)
        return np.maximum(np.exp(total - total.max(axis=1, keepdims=True)), 1e-9)

    def infer(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions over all languages, those over the selected ones (0 elsewhere) and the words, by row."""
        n, k = len(texts), max(1, len(self.languages))
        full, chosen, words = np.zeros((n, k)), np.zeros((n, k)), np.zeros(n, np.int64)
        if not self.languages:
            return full, chosen, words
        for s in slices(texts, limit=max(1 << 16, SLICE_BYTES * 4 // max(4, k)), letters=True):
            with_words = np.flatnonzero(s.n_words)
            if not len(with_words):
                continue
            p, n_words = self.word_likelihoods(s), s.n_words[with_words]
            pi, ll, gap = mixture(p, n_words, np.ones((len(n_words), k)))
            best, _ = select(p, n_words, pi, ll, gap)
            at = s.rows.start + with_words
            full[at], chosen[at], words[at] = pi, best, n_words
        return full, chosen, words


def mixture(p: np.ndarray, n_words: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for each document at once: proportions, log-likelihood, and by how much more the greatest one may exceed it.

    allowed: document x language, 1 where a language may take part.
    """
    out = allowed / allowed.sum(axis=1, keepdims=True)
    ll, gap = np.zeros(len(n_words)), np.zeros(len(n_words))
    open_ = np.arange(len(n_words))
    for i in range(ROUNDS + 1):
        pi, n = out[open_], n_words[open_]
        first = np.cumsum(n) - n
        mixed = np.einsum("wk,wk->w", p, np.repeat(pi, n, axis=0))
        pull = np.add.reduceat(p / mixed[:, None], first, axis=0) / n[:, None]
        now = pi * pull
        done = (np.abs(now - pi).max(axis=1) < SETTLED) | (i == ROUNDS)
        at = open_[done]
        ll[at] = np.add.reduceat(np.log(mixed), first)[done]
        gap[at] = n[done] * np.maximum((pull * allowed[open_]).max(axis=1)[done] - 1, 0)
        out[open_[~done]] = now[~done]
        if done.all():
            return out, ll, gap
        if done.any():
            p, open_ = p[np.repeat(~done, n)], open_[~done]
    return out, ll, gap


def select(
    p: np.ndarray, n_words: np.ndarray, pi: np.ndarray, ll: np.ndarray, gap: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the set of best penalised likelihood.

    Sets of two or more are only tried where the greatest likelihood of all languages, which bounds theirs, could
    still win.
    """
    n, k = pi.shape
    first = np.cumsum(n_words) - n_words
    single = np.add.reduceat(np.log(p), first, axis=0)
    top = single.argmax(axis=1)
    best, cost = np.eye(k)[top], 0.5 * np.log(np.maximum(n_words, 2))
    value = single[np.arange(n), top] - cost
    order = np.argsort(-pi, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    for m in range(2, k + 1):
        open_ = np.flatnonzero(ll + gap - m * cost > value)
        if not len(open_):
            break
        now, now_ll = pi[open_], ll[open_]
        if m < k:
            words = np.repeat(np.isin(np.arange(n), open_), n_words)
            now, now_ll, _ = mixture(p[words], n_words[open_], (rank[open_] < m).astype(float))
        better = now_ll - m * cost[open_] > value[open_]
        best[open_[better]], value[open_[better]] = now[better], (now_ll - m * cost[open_])[better]
    return best, value


def fit_languages(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """docs: text and lang, of which rows with null lang or text are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}

        def emitted() -> pa.RecordBatch:
            rows = [(lang, i, t[i * BLOCK : (i + 1) * BLOCK].tobytes()) for lang, t in tables.items() for i in range((1 << BITS) // BLOCK)]
            tables.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "block", "counts"])

        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = b.column("text").filter(pa.array(langs == lang))
                table = tables.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for s in slices(texts, letters=True):
                    table += np.bincount(grams(s), minlength=1 << BITS)
                if len(tables) >= 64:
                    yield emitted()
        yield emitted()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, block int, counts binary"
    rows = docs.select("text", "lang").where("lang is not null and text is not null").mapInArrow(count, schema).groupBy("lang", "block").applyInArrow(add, schema).collect()
    languages = tuple(sorted({r.lang for r in rows}))
    counts = np.zeros((1 << BITS, len(languages)))
    for r in rows:
        counts[r.block * BLOCK : (r.block + 1) * BLOCK, languages.index(r.lang)] = np.frombuffer(r.counts, np.int64)
    return LanguageModel(languages, np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * (1 << BITS))).astype(np.float32))


def detect(model: LanguageModel, text: Column) -> Column:
    """struct(lang, score, languages): the prediction, its proportion among all languages, and the selected languages with their proportions."""

    @F.arrow_udf("struct<lang: string, score: double, languages: map<string, double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            full, chosen, words = model.infer(texts)
            lang, score, sets = [], [], []
            for i, t in enumerate(texts.to_pylist()):
                if not words[i] or not t or not has_letter(t):
                    lang.append("und"), score.append(0.0), sets.append([])
                    continue
                k = int(chosen[i].argmax())
                lang.append(model.languages[k]), score.append(float(min(1.0, max(0.0, full[i, k]))))
                sets.append([(model.languages[j], float(chosen[i, j])) for j in np.flatnonzero(chosen[i] > 0)])
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], ["lang", "score", "languages"])

    return run(text)


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and languages; columns of these names are replaced."""
    # columns of docs travel as one struct, so that only those of the results' names are replaced
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "languages")))
    told = docs.select(rest.alias("row"), detect(model, F.col("text")).alias("found"))
    return told.select("row.*", F.col("found.lang").alias("lang_pred"), "found.score", "found.languages")
