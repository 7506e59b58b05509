"""Document fingerprints by invertible Bloom lookup sketches of paragraphs (operator 7).

A paragraph (a piece up to a line end, or to a full stop, question or exclamation mark) has a 64-bit digest; the n-th
copy of one in a document has its own. Each digest is added to three cells of a small table (count, exclusive or of
digests, exclusive or of their checks). Sketches of two versions subtract cell by cell, and peeling cells that hold one
digest recovers the paragraphs that differ; where peeling gets stuck, both versions are sketched twice as large.

Defined results: a null text is the empty text, which has no paragraph; two such documents have likeness 1; the next
document goes by descending (doc_id, text hash), null ids last, and the last one's next is the first; a lone document is
its own next; repeated rows are documents of their own; further columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, MULT, mix, powers, slices, total_bytes

#: Cells of the published sketch, and of the first try at a difference.
CELLS, HASHES = 16, 3
#: Bytes of text in one stretch of documents on average, most stretches, and sampled rows a stretch for their edges.
STRETCH, STRETCHES, SAMPLED = 16 << 20, 1 << 16, 20
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, paragraphs long, changed long"
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and digest of every paragraph; blank pieces are none."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(_ENDS[data])
    starts = np.concatenate([[0], ends[:-1] + 1])
    up, down = powers(1 << max(16, len(data).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MULT)
    solid = np.concatenate([[0], np.cumsum(data > 32)])
    doc = np.searchsorted(np.cumsum(sizes), ends, side="right")
    on = solid[ends] > solid[starts]
    doc, h = doc[on], h[on]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.arange(len(h))
    copy = at - np.maximum.accumulate(np.where(fresh, at, 0))
    with np.errstate(over="ignore"):
        return doc, mix(h + copy.astype(np.uint64) * BASE)


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each digest, one in each third (rounded) of the table."""
    third = max(1, cells // HASHES)
    with np.errstate(over="ignore"):
        return np.stack([k * third + (mix(keys * np.uint64(2 * k + 3) + np.uint64(k)) % np.uint64(third if k < HASHES - 1 else cells - third * (HASHES - 1))).astype(np.int64) for k in range(HASHES)], 1)


def checks(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys ^ np.uint64(0x5851F42D4C957F2D))


def sketch(doc: np.ndarray, keys: np.ndarray, documents: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digests and checks of the cells of all documents."""
    at = (doc[:, None] * cells + places(keys, cells)).ravel()
    n = np.bincount(at, minlength=documents * cells).astype(np.int64)
    key, check = np.zeros(documents * cells, np.uint64), np.zeros(documents * cells, np.uint64)
    order = np.argsort(at, kind="stable")
    if len(order):
        starts = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
        each = np.repeat(keys, HASHES)[order]
        key[at[order][starts]] = np.bitwise_xor.reduceat(each, starts)
        check[at[order][starts]] = np.bitwise_xor.reduceat(checks(each), starts)
    return n.reshape(documents, cells), key.reshape(documents, cells), check.reshape(documents, cells)


def peel(n: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, digest and side (1 or -1) of each recovered difference, and whether a document's table came out empty."""
    documents, cells = n.shape
    n, key, check = n.ravel().copy(), key.ravel().copy(), check.ravel().copy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.arange(len(n))
    while len(live):
        pure = live[(np.abs(n[live]) == 1) & (check[live] == checks(key[live]))]
        if not len(pure):
            break
        doc, k, side = pure // cells, key[pure], n[pure]
        first = np.unique(np.stack([doc.astype(np.uint64), k], 1), axis=0, return_index=True)[1] if len(pure) > 1 else np.zeros(1, np.int64)
        doc, k, side = doc[first], k[first], side[first]
        out.append((doc, k, side))
        at = (doc[:, None] * cells + places(k, cells)).ravel()
        np.add.at(n, at, -np.repeat(side, HASHES))
        np.bitwise_xor.at(key, at, np.repeat(k, HASHES))
        np.bitwise_xor.at(check, at, np.repeat(checks(k), HASHES))
        live = np.unique(at)
    empty = ~((n != 0) | (key != 0) | (check != 0)).reshape(documents, cells).any(1)
    none = np.zeros(0, np.int64)
    d, k, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none.astype(np.uint64), none)
    return d, k, s, empty


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], documents: int, cells: int = CELLS) -> np.ndarray:
    """How many paragraphs differ between the two versions of each document, recovered from their sketches."""
    out = np.zeros(documents, np.int64)
    left = np.arange(documents)
    while len(left):
        where = np.full(documents, -1)
        where[left] = np.arange(len(left))
        x, y = (sketch(where[d[where[d] >= 0]], k[where[d] >= 0], len(left), cells) for d, k in (a, b))
        doc, _, _, empty = peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2])
        found = np.bincount(doc, minlength=len(left))
        out[left[empty]] = found[empty]
        left, cells = left[~empty], cells * 2
    return out


def text_form(n: np.ndarray, key: np.ndarray, check: np.ndarray) -> list[str]:
    """A sketch as text: count (4 bytes), digest (8) and half of the check (4) of each cell, in base 64."""
    cells = np.empty(n.shape, np.dtype([("n", "<i4"), ("key", "<u8"), ("check", "<u4")]))
    cells["n"], cells["key"], cells["check"] = n, key, check >> np.uint64(32)
    return [base64.b64encode(row.tobytes()).decode() for row in cells]


def likeness(own: np.ndarray, other: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Shared paragraphs over all paragraphs of two versions, by their numbers and the recovered differences."""
    every = own + other + apart
    return np.where(every > 0, (own + other - apart) / np.maximum(every, 1), 1.0)


def edit(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    edited = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    own, new, nxt = digests(texts), digests(edited), digests(following)
    n = [np.bincount(d[0], minlength=len(texts)) for d in (own, new, nxt)]
    apart, beyond = differing(own, new, len(texts)), differing(own, nxt, len(texts))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array(text_form(*sketch(*own, len(texts), CELLS)), pa.string()),
        pa.array(text_form(*sketch(*new, len(texts), CELLS)), pa.string()),
        pa.array(likeness(n[0], n[1], apart), pa.float64()),
        pa.array(likeness(n[0], n[2], beyond), pa.float64()),
        pa.array(n[0], pa.int64()),
        pa.array(apart, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in SCHEMA.split(", ")])


def _edges(docs: DataFrame, stretches: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and text hashes at which stretches begin, rising: even steps through a sample of at most about SAMPLED rows a stretch."""
    n = docs.count()
    share = max(1, n // max(1, stretches * SAMPLED))
    got = docs.filter(F.pmod(F.xxhash64("id", "h"), F.lit(share)) == 0).select("id", "h").distinct().toArrow()
    ids, h = got.column("id").to_numpy(), got.column("h").to_numpy()
    order = np.lexsort((h, ids))[:: max(1, len(ids) // max(1, stretches))][1:]
    return ids[order], h[order]


def _stretch(edges: tuple[np.ndarray, np.ndarray]):
    """How many edges a row (id, h) has reached, as a column function of narrow columns."""
    at, h = edges  # edges of one id stand together, by hash

    @F.pandas_udf("long")
    def of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        x, y = ids.to_numpy(np.int64), hashes.to_numpy(np.int64)
        below, upto = np.searchsorted(at, x, side="left"), np.searchsorted(at, x, side="right")
        out = upto.copy()
        for k in np.flatnonzero(upto > below):
            out[k] = below[k] + np.searchsorted(h[below[k] : upto[k]], y[k], side="right")
        return pd.Series(out)

    return of


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, following): each text with that of the next document in descending order of doc_id.

    Documents are dealt in stretches of about STRETCH bytes, at most STRETCHES, by edges from a bounded sample of (id,
    text hash), so neither sparse ids, nor null or repeated ones pile up. A stretch gets the first document of the one
    below as a guest. Only one narrow row a stretch goes through a window over all stretches.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"id": F.coalesce("doc_id", F.lit(-(1 << 63))), "h": F.xxhash64("text")})
    stretches = min(STRETCHES, max(1, math.ceil(total_bytes(docs, "text") / STRETCH)))
    docs = docs.withColumn("stretch", _stretch(_edges(docs, stretches))("id", "h"))
    # the first text of each stretch comes out of a partial maximum, so whole texts are shuffled once
    heads = docs.groupBy("stretch").agg(F.max(F.struct("id", "h", "text")).alias("head"))
    above = Window.orderBy(F.desc("stretch"))
    host = docs.select("stretch").distinct().select("stretch", F.lag("stretch").over(above).alias("host"), F.min("stretch").over(Window.orderBy(F.lit(1))).alias("least"))
    # the very first document visits the lowest stretch, after all its own
    guests = heads.join(host, "stretch").select(F.lit(None).cast("long").alias("doc_id"), "head.text", F.lit(None).cast("long").alias("id"), "head.h", F.coalesce("host", "least").alias("stretch"), F.lit(True).alias("guest"))
    every = docs.select("doc_id", "text", "id", "h", "stretch", F.lit(False).alias("guest")).unionByName(guests)
    order = Window.partitionBy("stretch").orderBy(F.col("guest"), F.desc_nulls_last("id"), F.desc("h"))
    return every.withColumn("following", F.lead("text").over(order)).filter(~F.col("guest")).select("doc_id", "text", "following")


def fingerprinted(documents: DataFrame) -> DataFrame:
    """One row for each document, as SCHEMA has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(k).to_pylist() for k in range(3))
            for a, b in slices([len(t) for t in texts], 1 << 19):
                yield compare(ids[a:b], texts[a:b], [f or "" for f in following[a:b]])

    return with_next(documents).mapInArrow(run, SCHEMA)
