"""Quality of documents by supervised subword embeddings (operator 8).

Hashed words, word pairs (a doubled word counts as such) and character trigrams and 4-grams have vectors; a document is the mean of the vectors of all
its features, a softmax layer gives the classes, and both are trained by stochastic gradients in numpy on a bounded
sample of labelled rows. Case and signs count, since layout is what marks poor text.

Defined results: a null or empty text has only the bias, so its score is the model's prior; rows are independent;
further columns pass through `annotate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULT, SLICE, SMALL, fresh_names, give_back, labelled_sample, mix, powers, slices

#: Bound of the labelled rows the model is fitted on; whole texts are used.
TRAIN_DOCS, BITS, WIDTH, EPOCHS, BATCH = 3000, 16, 8, 6, 64


def feature_numbers(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after another, and the n + 1 bounds between texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, bounds, down = len(codes), np.concatenate([[0], np.cumsum(sizes)]), np.uint64(64 - bits)
    if not n:
        return np.zeros(0, np.int64), bounds
    doc = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        three = codes[: max(n - 2, 0)] << np.uint64(42) | codes[1 : n - 1] << np.uint64(21) | codes[2:]
        gram3 = (three * MULT) >> down
        gram4 = ((three[:-1] * MULT) + codes[3:] * np.uint64(0xD1B54A32D192ED03)) * MULT >> down
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edge = np.ones(n, bool)
        edge[1:] = doc[1:] != doc[:-1]
        begin = np.flatnonzero(~space & (edge | np.concatenate([[True], space[:-1]])))
        last = np.concatenate([edge[1:], [True]])
        end = np.flatnonzero(~space & (last | np.concatenate([space[1:], [True]]))) + 1
        up, inverse = powers(1 << max(16, n.bit_length()))
        total = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[:n])])
        word = mix((total[end] - total[begin]) * inverse[begin])
        # a word said twice running is one feature, whatever the word
        pair = np.where(word[:-1] == word[1:], np.uint64(0xF00D << 48), mix(word[:-1] * np.uint64(3) + word[1:]))
    inside3, inside4 = doc[: len(gram3)] == doc[n - len(gram3) :], doc[: len(gram4)] == doc[n - len(gram4) :]
    word_doc = doc[begin]
    same = word_doc[1:] == word_doc[:-1]
    numbers = np.concatenate([gram3[inside3], gram4[inside4], word >> down, pair[same] >> down]).astype(np.int64)
    of = np.concatenate([doc[: len(gram3)][inside3], doc[: len(gram4)][inside4], word_doc, word_doc[1:][same]])
    order = np.argsort(of, kind="stable")
    return numbers[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])


@dataclass
class Model:
    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def odds(self) -> np.ndarray:
        """What each feature adds to the log odds of the second class, before the mean."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows between bounds; an empty part is 0."""
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def train(texts: list[str], labels: list[int], bits: int = BITS, width: int = WIDTH, epochs: int = EPOCHS, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    V = 1 << bits
    model = Model(rng.normal(0, 1 / width, (V, width)), rng.normal(0, 0.5, (width, 2)), np.zeros(2))
    docs = []
    for a, b in slices([len(t) for t in texts], 1 << 18):
        numbers, bounds = feature_numbers(texts[a:b], bits)
        for k in range(b - a):
            which, times = np.unique(numbers[bounds[k] : bounds[k + 1]], return_counts=True)
            docs.append((which.astype(np.int32), (times / max(1, times.sum())).astype(np.float32)))
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:  # one class, or none: the bias alone
        model.bias[:] = (0, 4) if len(labels) and labels[0] else (4, 0) if len(labels) else (0, 0)
        model.out[:] = 0
        return model
    memory = [np.full(a.shape, 1e-8) for a in (model.vectors, model.out, model.bias)]
    weight = np.sqrt(len(y) / (2 * np.bincount(y, minlength=2)))  # the rarer class counts more, by the root of its rarity
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            which, share = np.concatenate([docs[k][0] for k in part]), np.concatenate([docs[k][1] for k in part])
            bounds = np.concatenate([[0], np.cumsum([len(docs[k][0]) for k in part])])
            mean = _means(model.vectors[which] * share[:, None], bounds)
            z = mean @ model.out + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[y[part], None] / len(part)
            back = np.repeat(p @ model.out.T, np.diff(bounds), 0) * share[:, None]
            grads = (np.stack([np.bincount(which, back[:, k], V) for k in range(width)], 1), mean.T @ p, p.sum(0))
            for w, g, m in zip((model.vectors, model.out, model.bias), grads, memory, strict=True):
                m += g * g
                w -= rate * g / np.sqrt(m)
    return model


def scores(odds: np.ndarray, bias: float, texts: list[str | None]) -> np.ndarray:
    numbers, bounds = feature_numbers([t or "" for t in texts], len(odds).bit_length() - 1)
    z = _means(odds[numbers], bounds) / np.maximum(1, np.diff(bounds)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> Model:
    """Learn labels.quality from at most `rows` labelled documents outside the held-out third."""
    got = labelled_sample(documents, labels, "quality", rows)
    return train([r.text for r in got], [int(r.label == 1) for r in got])


def annotate(documents: DataFrame, model: Model, name: str = "quality_score", most: int = SLICE) -> DataFrame:
    """The documents with the score under this name; a column that has it is replaced. `most` is the number of characters taken at once."""
    kept = documents.drop(name)
    shared = kept.sparkSession.sparkContext.broadcast((model.odds(), float(model.bias[1] - model.bias[0])))  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = [scores(*shared.value, texts[a:b]) for a, b in slices([len(t or "") for t in texts], most)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else [], pa.float64())], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents with a score of `least` or more, with their own columns, whatever their names."""
    (name,) = fresh_names(documents.columns, "quality_score")
    model = fit(documents, labels)
    give_back()
    return annotate(documents, model, name, SMALL).filter(F.col(name) >= least).drop(name)
