"""Divergence of sources by joint histograms of word counts (operator 12).

Word counts are taken whole from every text. A language keeps the words in at least `least` of its documents. For two
sources of a language, what a word adds to their divergence depends on its two counts alone. So each pair of sources
tallies how many words have which two counts: words that both have are tallied where a word's counts meet, and cells with
a zero follow from the sources' own histograms, less what was tallied. Each combination is then evaluated once, for both
directions, times its multiplicity. No pair of counts leaves a task as a row of its own.

Defined results: null texts, languages and sources are empty texts; each row is a document, repeated ones too; a group
without words takes part with zero counts; a language without kept words has divergences of 0; ties by item; an empty
table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, utf8

LEAST, RANKS, UNIT = 3, 200, 1_000_000_000
#: Bytes of text that are counted together; pairs of counts that are tallied together, and combinations that a task holds.
TOGETHER, PAIRS, HELD = 1 << 22, 1 << 20, 1 << 20
#: Groups (language and source) that are broadcast; more of them are joined by shuffles.
GROUPS = 100_000
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, df) of a run of documents: occurrences, and documents that have the word."""
    data, offsets = utf8(batch.column("text"))
    letter = _LETTER[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], letter[:-1]])
    after = np.concatenate([letter[1:], [False]])
    starts = np.flatnonzero(letter & (~before | first[:-1]))
    ends = np.flatnonzero(letter & (~after | first[1:])) + 1
    held, at = _LOWER[data[letter]], np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(held)).dictionary_encode()
    size = max(1, len(words.dictionary))
    document = np.searchsorted(offsets, starts, side="right") - 1
    own, n = np.unique(document * size + words.indices.to_numpy(), return_counts=True)
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    key, place = np.unique(group[own // size] * size + own % size, return_inverse=True)
    total, df = np.bincount(place, n, len(key)).astype(np.int64), np.bincount(place, minlength=len(key)).astype(np.int64)
    of, term = np.divmod(key, size)
    lang, source = np.divmod(of, max(1, len(sources.dictionary)))
    names = [d.take(pa.array(i)).cast(pa.string()) for d, i in ((langs.dictionary, lang), (sources.dictionary, source), (words.dictionary, term))]
    return pa.RecordBatch.from_arrays([*names, pa.array(total), pa.array(df)], ["lang", "source", "term", "n", "df"])


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), TOGETHER):
                yield _counted(b.slice(a, z - a))

    rows = _named(documents).mapInArrow(count, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def kept_counts(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, of_lang, leads): the counts of kept words, with the language's; `leads` marks one row a word."""
    word = Window.partitionBy("lang", "term")
    got = counts.withColumns({"of_lang": F.sum("n").over(word), "docs": F.sum("df").over(word), "leads": F.min("source").over(word) == F.col("source")})
    return got.filter(F.col("docs") >= least).drop("docs", "df")


def group_totals(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, words, lang_size) of every group: its occurrences, its language's kept words and occurrences."""
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("leads").cast("long")).alias("led"))
    every = _named(documents).select("lang", "source").distinct().join(per, ["lang", "source"], "left").na.fill(0, ["size", "led"])
    langs = every.groupBy("lang").agg(F.sum("led").alias("words"), F.sum("size").alias("lang_size"))
    return every.drop("led").join(langs, "lang")


def _pairs_of_run(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for rows i < j of the same run, a bounded number at a time; ends gives the end of each row's run."""
    row = np.arange(len(ends))
    later = ends - 1 - row
    upto = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
        i = np.repeat(row[at:to], later[at:to])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[at:to] - upto[at], later[at:to])
        at = to


def joint_tallies(kept: DataFrame) -> DataFrame:
    """(lang, a_source, b_source, a, b, m): m words have count a in one source and b in a later one, both above zero.

    A word's counts are rows in a row; several rows for one combination are summed by who reads them.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["lang", "a_source", "b_source", "a", "b"]
        names: dict[str, int] = {}
        rest, held, size = None, [], 0

        def packed() -> pd.DataFrame:
            return pd.concat(held).groupby(keys, sort=False, as_index=False)["m"].sum()

        def told(found: pd.DataFrame) -> pa.RecordBatch:
            known = np.array(list(names), object)
            texts = [pa.array(known[found[c].to_numpy()], pa.string()) for c in keys[:3]]
            return pa.RecordBatch.from_arrays([*texts, *(pa.array(found[c].to_numpy(np.int64)) for c in ("a", "b", "m"))], [*keys, "m"])

        def take(rows: pa.Table) -> None:
            nonlocal held, size
            codes = [np.array([names.setdefault(v, len(names)) for v in d.dictionary.to_pylist()], np.int64)[d.indices.to_numpy()] for d in (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))]
            n, runs = rows.column("n").to_numpy(), _runs(rows)
            for i, j in _pairs_of_run(np.repeat(runs[1:], np.diff(runs))):
                found = pd.DataFrame({"lang": codes[0][i], "a_source": codes[1][i], "b_source": codes[1][j], "a": n[i], "b": n[j]})
                held.append(found.groupby(keys, sort=False, as_index=False).size().rename(columns={"size": "m"}))
                size += len(held[-1])
                if size > 2 * HELD:
                    held = [packed()]
                    size = len(held[0])

        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            last = int(_runs(rows)[-2]) if len(rows) else 0
            take(rows.slice(0, last))
            rest = rows.slice(last)
            if size > HELD:
                found = packed()
                held, size = [], 0
                yield told(found)
        if rest is not None and len(rest):
            take(rest)
        if held:
            yield told(packed())

    sorted_counts = kept.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return sorted_counts.mapInArrow(tally, "lang string, a_source string, b_source string, a long, b long, m long")


def _runs(rows: pa.Table) -> np.ndarray:
    """Where runs of the same language and word begin, and the end."""
    if not len(rows):
        return np.zeros(1, np.int64)
    lang, term = rows.column("lang").combine_chunks(), rows.column("term").combine_chunks()
    new = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)))
    return np.concatenate([[0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1, [len(rows)]])


def share(count: Column, size: Column, words: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (size + words)), exactly."""
    product = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return 1 + F.call_function("div", product, F.nullif(size + words, F.lit(0)).cast("decimal(20,0)"))


def surprise(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a_source, b_source, a, b, m) for each two sources of a language, zero cells included."""
    key = ("lang", "a_source", "b_source")
    one, other = groups.select("lang", F.col("source").alias("a_source"), "words"), groups.select("lang", F.col("source").alias("b_source"))
    pairs = one.join(other, "lang").filter("a_source < b_source")
    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    met = joint_tallies(kept).select(*key, F.explode(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))).alias("c"))
    own = kept.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m"))
    c = F.col("c")
    first = pairs.join(own.withColumnRenamed("source", "a_source"), ["lang", "a_source"]).select(*key, F.explode(F.array(cell(c, zero, m), cell(zero, zero, -m))).alias("c"))
    second = pairs.join(own.withColumnRenamed("source", "b_source"), ["lang", "b_source"]).select(*key, F.explode(F.array(cell(zero, c, m), cell(zero, zero, -m))).alias("c"))
    base = pairs.select(*key, cell(zero, zero, F.col("words")).alias("c"))
    every = met.unionByName(first).unionByName(second).unionByName(base).select(*key, "c.*")
    # a pair of a language without kept words keeps its only cell, of multiplicity 0
    return every.groupBy(*key, "a", "b").agg(F.sum("m").alias("m")).filter("m > 0 OR (a = 0 AND b = 0)")


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language."""
    sizes = [groups.select("lang", F.col("source").alias(f"{x}_source"), F.col("size").alias(f"{x}_size"), *(["words"] if x == "a" else [])) for x in "ab"]
    known = histograms(kept, groups).join(sizes[0], ["lang", "a_source"]).join(sizes[1], ["lang", "b_source"])
    p, q = (share(F.col(x), F.col(f"{x}_size"), F.col("words")) for x in "ab")
    shares = known.select("lang", "a_source", "b_source", "m", p.alias("p"), q.alias("q"))
    times = lambda f: F.coalesce(F.sum(F.col("m") * f), F.lit(0))
    summed = shares.groupBy("lang", "a_source", "b_source").agg(times(surprise(F.col("p"), F.col("q"))).alias("there"), times(surprise(F.col("q"), F.col("p"))).alias("back"))
    way = lambda s, t, v: F.struct(F.col(s).alias("source"), F.col(t).alias("item"), F.col(v).alias("value"))
    return summed.select("lang", F.explode(F.array(way("a_source", "b_source", "there"), way("b_source", "a_source", "back"))).alias("w")).select("lang", "w.*")


def telling_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the words that a source has more of than its language."""
    known = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("size"), F.col("words")), share(F.col("of_lang"), F.col("lang_size"), F.col("words"))
    return known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q").select("lang", "source", "item", surprise(F.col("p"), F.col("q")).alias("value"))


def report(documents: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and the `ranks` most telling words of each source."""
    kept = materialize(kept_counts(word_counts(documents), least))
    groups = materialize(group_totals(documents, kept))
    if groups.count() <= GROUPS:
        groups = F.broadcast(groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_divergences(kept, groups), "pair").unionByName(ranked(telling_terms(kept, groups), "term").filter(F.col("rank") <= ranks))
