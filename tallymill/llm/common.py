"""Helpers the corpus operators share: shared-folder checkpoints, hold-out rule, Arrow text buffers, word arrays."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.checkpoints import shared_folder

MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Characters a task turns into arrays at once; bounds the memory of a Python worker, not the input.
SLICE = 1 << 20
#: The same for stages of a pipeline, whose Python workers keep what each stage grew them to.
SMALL = 1 << 18


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query has ended; for jobs whose result is written, so that nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, which takes the setting


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as Parquet in the shared folder, bucketed by `key` as shuffles deal it, so later joins on it move the other side alone."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with released(spark):
        df.select("*").write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, they are in a folder of their own
    return rows


def fresh_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has (names differ by more than case), so that an input's own columns stay."""
    taken = {c.lower() for c in columns}
    mark = ""
    while any(f"{mark}{w}".lower() in taken for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 on division by 3 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, rows: int) -> list:
    """(doc_id, text, label) of at most `rows` labelled training documents, the smallest by a hash of their id.

    The bound makes both the sample of labels that is broadcast and what the driver receives a fixed size.
    """
    keep = F.col(target).isNotNull() & ~held_out(F.col("doc_id"))
    picked = labels.filter(keep).groupBy("doc_id").agg(F.min(target).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()


def give_back() -> None:
    """What a training on the driver has freed goes back to the system, where the C library would keep it for the whole job."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def total_bytes(texts: DataFrame, column: str) -> int:
    return texts.agg(F.sum(F.octet_length(F.col(column)).cast("bigint"))).first()[0] or 0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text or binary array without copying each value; nulls are empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(sizes, most: int = SLICE):
    """Consecutive (from, to) row ranges of about `most` characters each; a longer text stands alone and whole."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield at, k
            at, held = k, 0
        held += int(n)
    if at < len(sizes):
        yield at, len(sizes)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse ** i modulo 2 ** 64 (BASE is odd)."""
    with np.errstate(over="ignore"):
        one = np.ones(n, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = BASE, np.uint64(pow(int(BASE), -1, 1 << 64))
        return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * MULT
        return h ^ (h >> np.uint64(29))


class Letters:
    """The lower-cased texts as code points, and the letter runs (words) in them.

    codes, doc_of_word, starts, ends are arrays; hashes(a, b) gives a 64-bit hash of each codes[a:b].
    """

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        joined = "\n".join(lowered) + "\n"
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.doc_ends = np.cumsum([len(t) + 1 for t in lowered])
        self.letter = letter_table()[self.codes]
        edge = np.flatnonzero(np.diff(self.letter.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.doc_of_word = np.searchsorted(self.doc_ends, self.starts, side="right")
        size = 1 << max(16, int(len(self.codes)).bit_length())
        self._up, self._down = powers(size)
        with np.errstate(over="ignore"):
            self._sum = np.concatenate([[np.uint64(0)], np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * self._up[: len(self.codes)])])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sum[b] - self._sum[a]) * self._down[a])


@lru_cache(maxsize=1)
def odd_signs() -> frozenset[str]:
    """Characters that Python's own classes take differently from Unicode's letters, numbers and white space, or whose
    class differs between the installed tables of Python and of the regex library."""
    import regex

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    letters, numbers, digits, blanks = (set(regex.findall(p, "".join(every))) for p in (r"\p{L}", r"\p{N}", r"\p{Nd}", r"\p{White_Space}"))
    return frozenset(c for c in every if (c in letters) != c.isalpha() or (c in digits) != c.isdecimal() or (c in blanks) != c.isspace() or c in numbers and c not in digits)


def has_odd(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    return not odd_signs().isdisjoint(text)
