"""Toxicity by the nearest labelled examples under exact TF-IDF cosine (operator 4).

Terms are all words, hashed to TERMS numbers; their document frequencies are counted over all documents, and a term that
goes with a label in the training rows weighs more (no term is left out). All labelled examples of both labels stand in
an inverted index, dealt into blocks: the postings of a term are cut by block, and each piece keeps its largest weight.
A document adds up these maxima to a bound for each block, is compared with its most promising block, and then only with
blocks whose bound reaches its nearest examples so far, so the neighbours are exact. Their votes are weighted by
closeness and calibrated on the examples themselves, each left out.

Defined results: a text without any word (null and empty texts too), or that shares none with an example, has no
neighbour and gets the rate of label 1 among such examples. Equal similarities prefer the smaller example number; rows
are independent; columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Letters, labelled_sample, slices

#: Bound of the labelled examples, numbers that words are hashed to, neighbours that vote, examples of a block.
EXAMPLES, TERMS, NEIGHBOURS, BLOCK = 5000, 1 << 18, 15, 64
#: Postings that a task adds up at once; bounds memory, not the input.
AT_ONCE = 1 << 21


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term number and frequency of each term that occurs, sorted by document and term."""
    x = Letters(texts)
    term = (x.hashes(x.starts, x.ends) >> np.uint64(64 - TERMS.bit_length() + 1)).astype(np.int64)
    joint, n = np.unique(x.doc_of_word * np.int64(TERMS) + term, return_counts=True)
    return joint // TERMS, joint % TERMS, n


def label_weights(doc: np.ndarray, term: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weight of each term: 1 where it says nothing about the label, and more by the third power of its standard score for label 1."""
    ones, zeros = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    n, hits = np.bincount(term, minlength=TERMS), np.bincount(term, labels[doc] if len(doc) else None, TERMS)
    share = n / max(1, len(labels))
    z = (hits / ones - (n - hits) / zeros) / np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros) + 1e-12)
    return (1 + np.where((n > 0) & (n < len(labels)), np.maximum(z, 0), 0) ** 3 / 64).astype(np.float32)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Index:
    """Postings by term, cut into pieces by block; a piece knows its block and its largest weight."""

    examples: int
    first_piece: np.ndarray
    piece_block: np.ndarray
    piece_max: np.ndarray
    piece_start: np.ndarray
    posting_example: np.ndarray
    posting_weight: np.ndarray

    @staticmethod
    def of(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int) -> Index:
        order = np.lexsort((doc, term))
        doc, term, weight = doc[order], term[order], weight[order]
        block = doc // BLOCK
        cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(doc) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, cut) if len(cut) else np.zeros(0, np.float32)
        first = np.searchsorted(term[cut], np.arange(TERMS + 1)).astype(np.int32)
        return Index(examples, first, block[cut].astype(np.int32), most, np.append(cut, len(doc)).astype(np.int32), doc.astype(np.int32), weight)

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, documents: int, k: int = NEIGHBOURS, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Example numbers and cosines of the k nearest examples (cosine over 0) of each document, and how many blocks were added up.

        Documents come as their terms, sorted by document; -1 fills missing places. `leave` names one example that each leaves out.
        """
        blocks = -(-self.examples // BLOCK)
        near, value, opened = np.full((documents, k), -1, np.int64), np.zeros((documents, k)), 0
        if not blocks or not len(doc):
            return near, value, opened
        pieces = self.first_piece[term + 1] - self.first_piece[term]
        sizes = np.bincount(doc, self.piece_start[self.first_piece[term + 1]] - self.piece_start[self.first_piece[term]], documents)
        for a, b in slices(sizes + self.examples, AT_ONCE):
            x, y = np.searchsorted(doc, [a, b])
            piece = _spread(self.first_piece[term[x:y]], pieces[x:y])
            of, heavy = np.repeat(doc[x:y] - a, pieces[x:y]), np.repeat(weight[x:y], pieces[x:y])
            cell = of * blocks + self.piece_block[piece]
            bound = np.bincount(cell, heavy * self.piece_max[piece], (b - a) * blocks).reshape(-1, blocks) * (1 + 1e-5)
            score = np.zeros((b - a) * self.examples)
            best, floor = bound.argmax(1), np.zeros(b - a)
            opening = np.zeros_like(bound, bool)
            opening[np.arange(b - a), best] = True
            opening &= bound > 0
            for turn in (0, 1):
                opened += int(opening.sum())
                on = opening.ravel()[cell]
                size = self.piece_start[piece[on] + 1] - self.piece_start[piece[on]]
                at = _spread(self.piece_start[piece[on]], size)
                score += np.bincount(np.repeat(of[on], size) * self.examples + self.posting_example[at], np.repeat(heavy[on], size) * self.posting_weight[at], len(score))
                if turn == 0:
                    inside = np.pad(score.reshape(b - a, -1), ((0, 0), (0, blocks * BLOCK - self.examples))).reshape(b - a, blocks, BLOCK)[np.arange(b - a), best]
                    if leave is not None:
                        inside[best[:, None] * BLOCK + np.arange(BLOCK) == leave[a:b, None]] = 0
                    floor = np.sort(inside, 1)[:, -k] if k <= BLOCK else floor
                    # a block is passed over only if its bound cannot reach the k-th nearest of the first one
                    opening = (bound > 0) & (bound >= floor[:, None]) & ~opening
            score = score.reshape(b - a, -1)
            if leave is not None:
                score[np.arange(b - a), leave[a:b]] = 0
            some = min(k, self.examples)
            least = -np.partition(-score, some - 1, 1)[:, some - 1]
            for row in range(b - a):
                found = np.flatnonzero((score[row] >= least[row]) & (score[row] > 0))
                found = found[np.lexsort((found, -score[row, found]))][:k]
                near[a + row, : len(found)], value[a + row, : len(found)] = found, score[row, found]
        return near, value, opened


@dataclass
class Model:
    weights: np.ndarray
    index: Index
    labels: np.ndarray
    ids: np.ndarray
    steps: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    empty: float = 0.0

    def votes(self, best: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Share of closeness that votes for label 1, drawn a little towards the rate of texts without neighbours."""
        weight = value.astype(np.float64) ** 2 * (best >= 0)
        return ((weight * self.labels[np.maximum(best, 0)]).sum(1) + 1e-4 * self.empty) / (weight.sum(1) + 1e-4) if len(self.labels) else np.full(len(best), self.empty)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated scores and the numbers of the nearest examples."""
        doc, term, weight = vectors([t or "" for t in texts], self.weights)
        near, value, _ = self.index.nearest(doc, term, weight, len(texts))
        out = np.full(len(texts), self.empty)
        some = np.flatnonzero(near[:, 0] >= 0)
        if len(some):
            out[some] = np.interp(self.votes(near[some], value[some]), self.steps, self.levels)
        return np.clip(out, 0, 1), near


def unit(doc: np.ndarray, term: np.ndarray, n: np.ndarray, documents: int, weights: np.ndarray) -> np.ndarray:
    """Weights of terms in documents, each document of length 1."""
    w = (1 + np.log(n)) * weights[term]
    size = np.sqrt(np.bincount(doc, w * w, documents))
    return (w / size[doc]).astype(np.float32)


def vectors(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, term, n = counts(texts)
    return doc, term, unit(doc, term, n, len(texts), weights)


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step means of y over x (pool adjacent violators)."""
    parts: list[list[float]] = []
    for a, b in zip(*(v[np.argsort(x, kind="stable")].tolist() for v in (x, y)), strict=True):
        parts.append([b, 1, a])
        while len(parts) > 1 and parts[-2][0] >= parts[-1][0]:
            m, n, at = parts.pop()
            p, k, was = parts[-1]
            parts[-1] = [(p * k + m * n) / (k + n), k + n, (was * k + at * n) / (k + n)]
    return np.array([p[2] for p in parts]), np.array([p[0] for p in parts])


def build(texts: list[str], labels: np.ndarray, ids: np.ndarray, frequency: np.ndarray, documents: int) -> Model:
    parts = [(a, counts(texts[a:b])) for a, b in slices([len(t) for t in texts])]
    none = np.zeros(0, np.int64)
    doc, term, n = (np.concatenate([none, *x]) for x in (([p[0] + a for a, p in parts]), [p[1] for _, p in parts], [p[2] for _, p in parts]))
    idf = np.log1p(documents / (1.0 + frequency)).astype(np.float32)
    weights = idf * label_weights(doc, term, labels)
    w = unit(doc, term, n, len(texts), weights)
    # examples whose heaviest term is one and the same share blocks, so that bounds are close
    heaviest = np.full(len(texts), TERMS)
    order = np.lexsort((w, doc))
    last = np.flatnonzero(np.append(doc[order][1:] != doc[order][:-1], True)) if len(doc) else none
    heaviest[doc[order][last]] = term[order][last]
    rank = np.argsort(heaviest, kind="stable")
    place = np.empty(len(texts), np.int64)
    place[rank] = np.arange(len(texts))
    order = np.lexsort((term, place[doc]))
    doc, term, w = place[doc][order], term[order], w[order]
    model = Model(weights, Index.of(doc, term, w, len(texts)), labels[rank].astype(np.float64), ids[rank])
    if len(texts):
        near, value, _ = model.index.nearest(doc, term, w, len(texts), leave=np.arange(len(texts)))
        alone = near[:, 0] < 0
        model.empty = float((model.labels[alone].sum() + model.labels.mean()) / (alone.sum() + 1))
        if not alone.all():
            model.steps, model.levels = _isotonic(model.votes(near[~alone], value[~alone]), model.labels[~alone])
    return model


def fit(documents: DataFrame, labels: DataFrame, rows: int = EXAMPLES) -> Model:
    """Examples from at most `rows` labelled documents; document frequencies from all documents."""
    got = labelled_sample(documents, labels, "toxic", rows)
    texts, y = [r.text for r in got], np.array([int(r.label == 1) for r in got], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            part = batch.column(0).to_pylist()
            seen += len(part)
            for a, b in slices([len(t or "") for t in part]):
                total[:-1] += np.bincount(counts([t or "" for t in part[a:b]])[1], minlength=TERMS)
        total[-1] = seen
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["term", "n"])

    frequency = np.zeros(TERMS + 1, np.int64)
    found = documents.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most TERMS + 1 rows
    frequency[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return build(texts, y, np.array([r.doc_id or 0 for r in got], np.int64), frequency[:-1], int(frequency[-1]))


def annotate(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with toxic_score and toxic_evidence (ids of the nearest labelled examples); such columns are replaced."""
    kept = documents.drop("toxic_score", "toxic_evidence")
    shared = kept.sparkSession.sparkContext.broadcast(model)  # the terms of at most EXAMPLES texts, and TERMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, score, near = batch.column("text").to_pylist(), [], []
            for a, b in slices([len(t or "") for t in texts]):
                s, n = shared.value.score(texts[a:b])
                score.extend(s)
                near.extend([shared.value.ids[x[x >= 0]].tolist() for x in n])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=[*batch.schema.names, "toxic_score", "toxic_evidence"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_evidence", T.ArrayType(T.LongType()))]))
