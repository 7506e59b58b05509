"""Language of words and documents by a linear-chain conditional random field (operator 2).

A chain is the words (letter runs) between two sentence ends or line breaks. Emission scores sum hashed affix weights,
hashed character-trigram weights and the weight of the word itself where it is in the learned lexicon; transitions
are learned. Forward-backward gives each word's distribution over languages; a document's language has the most
probability, words weighted by their letters.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the smaller language name.
Rows are independent, so repeated rows repeat their answer, and further columns pass through `annotate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULT, SLICE, SMALL, Letters, fresh_names, give_back, held_out, mix, slices

UNKNOWN = "und"
#: Bound of the labelled rows the model is fitted on; whole texts are used.
TRAIN_DOCS, EPOCHS, BITS, LEXICON_LEAST = 1500, 2, 16, 3
_BREAKS = np.array([10, 13, 33, 46, 63, 0x2026, 0x3002], np.uint32)


@dataclass
class Features:
    """Words of some texts: affix feature numbers, trigram numbers of each letter, lexicon rows, chain bounds."""

    affix: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray
    words: np.ndarray
    weight: np.ndarray
    doc: np.ndarray
    chain_starts: np.ndarray
    chain_sizes: np.ndarray


def features(texts: list[str], bits: int = BITS) -> Features:
    x = Letters(texts)
    s, e, codes = x.starts, x.ends, x.codes.astype(np.uint64)
    none = np.zeros(0, np.int64)
    if not len(s):
        return Features(np.zeros((0, 6), np.int64), none, none, none.astype(np.uint64), none, none, none, none)
    down = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        code = lambda k, at: codes[k] + np.uint64(1) if at is None else np.where(at, codes[k] + np.uint64(1), np.uint64(0))
        size, affix, front, back = e - s, [], np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
        for k in range(3):
            front = front << np.uint64(21) | code(np.minimum(s + k, e - 1), size > k)
            back = back << np.uint64(21) | code(np.maximum(e - 1 - k, s), size > k)
            affix += [mix(front * np.uint64(2 * k + 3)) >> down, mix(back * np.uint64(2 * k + 4) + np.uint64(k)) >> down]
        plain = np.where(x.letter, codes, np.uint64(32))
        near = plain << np.uint64(21)
        near[1:] |= plain[:-1] << np.uint64(42)
        near[:-1] |= plain[1:]
        on = np.flatnonzero(x.letter)
        grams = (near[on] * MULT >> down).astype(np.int64)
    stop = np.isin(x.codes, _BREAKS)
    stop[x.doc_ends - 1] = True
    part = np.cumsum(stop)[s]
    fresh = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return Features(np.stack(affix, 1).astype(np.int64), grams, np.concatenate([[0], np.cumsum(size)[:-1]]), x.hashes(s, e), size, x.doc_of_word, fresh, np.diff(np.append(fresh, len(s))))


def gathered(texts: list[str], bits: int = BITS) -> Features:
    """Features of many texts, taken a slice at a time into narrow arrays."""
    parts, docs = [], 0
    for a, b in slices([len(t) for t in texts], 1 << 18):
        f = features(texts[a:b], bits)
        parts.append(Features(f.affix.astype(np.int32), f.grams.astype(np.int32), f.gram_at, f.words, f.weight.astype(np.int32), f.doc + docs, f.chain_starts, f.chain_sizes))
        docs += b - a
    if not parts:
        return features([], bits)
    grams, words = (np.concatenate([[0], np.cumsum([len(x) for x in each])]) for each in ([f.grams for f in parts], [f.words for f in parts]))
    moved = {"gram_at": grams, "chain_starts": words}
    return Features(*[np.concatenate([getattr(f, n) + moved[n][k] if n in moved else getattr(f, n) for k, f in enumerate(parts)]) for n in ("affix", "grams", "gram_at", "words", "weight", "doc", "chain_starts", "chain_sizes")])


@dataclass
class Model:
    labels: list[str]
    lexicon: np.ndarray
    word_weights: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        out = np.add.reduceat(self.weights[f.grams], f.gram_at, 0) if len(f.grams) else np.zeros((0, len(self.labels)), np.float32)
        for k in range(f.affix.shape[1]):
            out += self.weights[f.affix[:, k]]
        at, known = self.lookup(f.words)
        out[known] += self.word_weights[at[known]]
        return out

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.lexicon):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.lexicon, words), len(self.lexicon) - 1)
        return at, self.lexicon[at] == words


def forward_backward(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of every word and, if asked for, the expected count of each transition.

    All chains step together; words are kept by step, then chain, so that a step is one stretch of the arrays.
    """
    if not len(scores):
        return np.zeros(scores.shape), np.zeros(moves.shape) if pairs else None
    go = np.exp(moves.astype(np.float64))
    rank = np.empty(len(sizes), np.int64)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
    step = np.arange(len(scores)) - np.repeat(starts, sizes)
    live = np.bincount(step)  # chains longer than t
    at = np.concatenate([[0], np.cumsum(live)])
    place = at[step] + np.repeat(rank, sizes)
    e = np.empty(scores.shape)
    e[place] = np.exp((scores - scores.max(1, keepdims=True)).astype(np.float64)) + 1e-300
    alpha, beta = np.empty_like(e), np.ones_like(e)
    ones = np.ones((e.shape[1], e.shape[1]))
    for t, m in enumerate(live):
        a = e[:m] if t == 0 else (alpha[at[t - 1] : at[t - 1] + m] @ go) * e[at[t] : at[t] + m]
        alpha[at[t] : at[t] + m] = a / (a @ ones)
    for t in range(len(live) - 2, -1, -1):
        m = live[t + 1]
        b = (e[at[t + 1] : at[t + 1] + m] * beta[at[t + 1] : at[t + 1] + m]) @ go.T
        beta[at[t] : at[t] + m] = b / (b @ ones)
    gamma = alpha * beta
    gamma /= gamma @ ones
    total = None
    if pairs:
        total = np.zeros(moves.shape)
        for t in range(len(live) - 1):
            m = live[t + 1]
            left, right = alpha[at[t] : at[t] + m], e[at[t + 1] : at[t + 1] + m] * beta[at[t + 1] : at[t + 1] + m]
            total += (left / ((left @ go) * right).sum(1, keepdims=True)).T @ right * go
    return gamma[place], total


def _mixed(f: Features, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains in random order, a third of them joined to the next one, so that switches occur; word order, starts, sizes."""
    order = rng.permutation(len(f.chain_starts))
    sizes = f.chain_sizes[order]
    words = np.repeat(f.chain_starts[order] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    fresh = rng.random(len(order)) > 1 / 3
    fresh[0] = True
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[fresh]
    return words, starts, np.diff(np.append(starts, len(words)))


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, bits: int = BITS, seed: int = 7) -> Model:
    """Maximum likelihood by stochastic gradients (Adagrad) with every word labelled by its document's language."""
    labels = sorted(set(langs))
    f = gathered(texts, bits)
    gold = np.array([labels.index(v) for v in langs], np.int64)[f.doc] if len(f.doc) else np.zeros(0, np.int64)
    words, times = np.unique(f.words, return_counts=True)
    lexicon = words[times >= LEXICON_LEAST]
    L, V, W = len(labels), 1 << bits, len(lexicon)
    model = Model(labels, lexicon, np.zeros((W, L), np.float32), np.zeros((V, L), np.float32), np.zeros((L, L), np.float32))
    if not len(gold):
        return model
    memory, rng = [np.full(a.shape, 1e-3) for a in (model.weights, model.word_weights, model.moves)], np.random.default_rng(seed)
    gram_ends = np.append(f.gram_at[1:], len(f.grams))
    for _ in range(epochs):
        words, starts, sizes = _mixed(f, rng)
        cuts = np.searchsorted(starts, np.arange(0, len(words), 20_000))
        for a, b in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
            if a == b:
                continue
            at = words[starts[a] : starts[b - 1] + sizes[b - 1]]
            counts = gram_ends[at] - f.gram_at[at]
            base = np.concatenate([[0], np.cumsum(counts)[:-1]])
            grams = f.grams[np.repeat(f.gram_at[at] - base, counts) + np.arange(counts.sum())]
            part = Features(f.affix[at], grams, base, f.words[at], f.weight[at], f.doc[at], starts[a:b] - starts[a], sizes[a:b])
            gamma, pairs = forward_backward(model.emissions(part), model.moves, part.chain_starts, part.chain_sizes, True)
            y, n = gold[at], len(at)
            grad = -gamma
            grad[np.arange(n), y] += 1
            inside = np.ones(n, bool)
            inside[part.chain_starts] = False
            nxt = np.flatnonzero(inside)
            moved = np.bincount(y[nxt - 1] * L + y[nxt], minlength=L * L).reshape(L, L) - pairs
            every = np.repeat(grad, counts, 0)
            known_at, known = model.lookup(part.words)
            sums = np.empty((V, L))
            extra = np.empty((W, L))
            for k in range(L):
                sums[:, k] = np.bincount(grams, every[:, k], V) + np.bincount(part.affix.ravel(), np.repeat(grad[:, k], part.affix.shape[1]), V)
                extra[:, k] = np.bincount(known_at[known], grad[known, k], W)
            for w, g, m in zip((model.weights, model.word_weights, model.moves), (sums / n, extra / n, moved / n), memory, strict=True):
                m += g * g
                w += (0.2 * g / np.sqrt(m)).astype(np.float32)
    return model


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[int]]:
    """Language, its share of the probability, and words labelled, for each text."""
    texts = [t or "" for t in texts]
    f = features(texts, int(model.weights.shape[0]).bit_length() - 1)
    L = len(model.labels)
    if not L:  # nothing was learned
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.bincount(f.doc, minlength=len(texts)).tolist()
    gamma, _ = forward_backward(model.emissions(f), model.moves, f.chain_starts, f.chain_sizes)
    mass = np.stack([np.bincount(f.doc, gamma[:, k] * f.weight, len(texts)) for k in range(L)], 1) if L and len(f.doc) else np.zeros((len(texts), max(L, 1)))
    total, best = mass.sum(1), mass.argmax(1)
    score = np.where(total > 0, mass[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
    return [model.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)], np.clip(score, 0, 1), np.bincount(f.doc, minlength=len(texts)).tolist()


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text."""
    f, x = features([text], int(model.weights.shape[0]).bit_length() - 1), Letters([text])
    gamma, _ = forward_backward(model.emissions(f), model.moves, f.chain_starts, f.chain_sizes)
    low = text.lower()
    return [(low[a:b], model.labels[int(g.argmax())], float(g.max())) for a, b, g in zip(x.starts, x.ends, gamma, strict=True)]


def fit(documents: DataFrame, rows: int = TRAIN_DOCS) -> Model:
    """Learn from text and lang of at most `rows` documents outside the held-out third, the smallest by a hash of the id."""
    usable = documents.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # whole texts travel only for the documents chosen
    chosen = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    got = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(rows).collect()
    return train([r.text for r in got], [r.lang for r in got])


#: What annotate adds, if not told otherwise.
NAMES = ("lang_pred", "lang_score", "lang_words")


def annotate(documents: DataFrame, model: Model, names: tuple[str, ...] = NAMES, most: int = SLICE) -> DataFrame:
    """The documents with prediction, score and number of words under these names; columns that have them are replaced.

    `most` is the number of characters taken at once.
    """
    kept = documents.drop(*names)
    added = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.LongType()), strict=True)]
    schema = T.StructType([*kept.schema.fields, *added])
    shared = kept.sparkSession.sparkContext.broadcast(model)  # its size is set by BITS, the lexicon and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, got = batch.column("text").to_pylist(), ([], [], [])
            for a, b in slices([len(t or "") for t in texts], most):
                for into, part in zip(got, predict(shared.value, texts[a:b]), strict=True):
                    into.extend(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.int64())], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def accepted(documents: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents whose language is known with a probability of `least` or more, with their own columns, whatever their names."""
    model = fit(documents)
    give_back()
    names = tuple(fresh_names(documents.columns, *NAMES))
    rows = annotate(documents, model, names, SMALL)
    return rows.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).drop(*names)


__all__ = ["Model", "accepted", "annotate", "fit", "forward_backward", "label_words", "predict", "train"]
