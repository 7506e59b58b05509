"""SimHash near-duplicates by anchor-point covering (operator 3).

A fingerprint is cut into 31-bit blocks (one bit of 32 left out). The anchors of a block are the words of the perfect
Hamming code of length 31: covering radius 1, 2 ** 26 words. With a threshold of 2 * blocks - 1 bits, two linked
fingerprints differ by at most one bit in some block, so each goes to every anchor within radius 1 + 1 of it (at most
16 a block) and meets all its partners at an anchor; there all members are compared. Each anchor reports the links as
a forest, so copies never become all pairs. Equal fingerprints are one from the start. The members of a hot anchor go on
to a second level: two of them differ by at most one bit in one half of the other block, so they meet again at an anchor
of the Hamming code of length 15; where that is hot too, its members are compared block against block over tasks.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; a text with fewer
words than a shingle is one shingle; `groups` returns a row for each row of the table; a null doc_id is returned as null
and takes no part in the smallest id (a component of null ids alone has a null component_id). `representatives` keeps
every column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MULT, SMALL, bucketed, materialize, mix, slices
from .components import components, local_roots

SEED, WORDS, BITS_APART = 42, 3, 3
#: Shingle and similarity of the pipeline's near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Documents whose frequent shingles go last (a sample), such shingles kept, rows of tokens a task, members of a token's block.
SAMPLE, USUAL, TOKEN_ROWS, HOT = 5000, 100_000, 200_000, 2000
#: Bits of the wide sketch, and smallest texts that a text is held against before all the rest.
WIDE, KIN = 1024, 3
#: Partners of one document that one task verifies, and pairs that one task compares, or holds, at once.
SHARE, PAIRS = 500, 1 << 17
#: Rows of tokens of one smallest node that stay together.
TOGETHER = 50_000
#: Rows of anchors that one task compares, on average, and the most at one anchor that are compared there.
ANCHOR_ROWS, HOT_ANCHOR = 200_000, 2000
_BLANK = re.compile(rb"[\x20\x09-\x0d]+")
_UPPER = bytes(range(65, 91))
_LOWER = _UPPER.lower()
_FOLD = bytes.maketrans(_UPPER, _LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks of the text, A-Z lower-cased, as UTF-8."""
    return [w for w in _BLANK.split((text or "").encode("utf-8", "surrogatepass").translate(_FOLD)) if w]


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of each shingle, repeats included; the whole sequence where it is shorter; none without words."""
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])]  # noqa: B905


def majority(each: list[list[int]], lanes: int) -> np.ndarray:
    """A row of `lanes` 64-bit words for each list of hashes: bit set where it is set in over half of them; no hash gives zeros.

    Lane 0 uses the hashes themselves, further lanes mix them anew.
    """
    out = np.zeros((len(each), lanes), np.uint64)
    counts = np.array([len(x) for x in each], np.int64)
    for a, b in slices(counts, 1 << 17):
        some = a + np.flatnonzero(counts[a:b])
        if not len(some):
            continue
        h = np.array([v for x in each[a:b] for v in x], np.uint64)
        starts = np.cumsum(counts[some]) - counts[some]
        for lane in range(lanes):
            with np.errstate(over="ignore"):
                now = h if lane == 0 else mix((h + np.uint64(lane)) * MULT)
            bits = np.unpackbits(now[:, None].view(np.uint8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, starts, 0, dtype=np.int32)
            out[some, lane] = np.packbits(2 * sums > counts[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(texts: list[str | None], size: int, lanes: int) -> np.ndarray:
    """The majority words of each text's shingles."""
    parts = [majority([shingle_hashes(words_of(t), size) for t in texts[a:b]], lanes) for a, b in slices([len(t or "") for t in texts], 1 << 18)]
    return np.concatenate([np.zeros((0, lanes), np.uint64), *parts])


def fingerprinted(documents: DataFrame, size: int = WORDS, lanes: int = 1) -> DataFrame:
    """(doc_id, fp): fp is an array of `lanes` longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fingerprints(batch.column(1).to_pylist(), size, lanes).view(np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, lanes), pa.int32()), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "fp"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp array<long>")


def _odd(x: Column, mask: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(mask))).cast("long").bitwiseAND(F.lit(1))


def anchors(block: Column, checks: int = 5) -> Column:
    """All code words within two bits of a block of 2 ** checks - 1 bits, as an array of longs.

    The syndrome s of the Hamming code is the exclusive or of the places (from 1) of set bits; flipping places i and
    i xor s (0 flips none) leads to a code word.
    """
    size = (1 << checks) - 1
    masks = [sum(1 << (p - 1) for p in range(1, size + 1) if p >> k & 1) for k in range(checks)]
    s = sum((F.shiftleft(_odd(block, m), k) for k, m in enumerate(masks)), F.lit(0).cast("long"))
    flip = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (i - 1).cast("int")))
    places = F.sequence(F.lit(0).cast("long"), F.lit(size).cast("long"))
    found = F.transform(F.filter(places, lambda i: i < i.bitwiseXOR(s)), lambda i: block.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(s))))
    return F.when(s == 0, F.array(block)).otherwise(found)


def anchored(prints: DataFrame, blocks: int) -> DataFrame:
    """(key, ...): each row of `prints` (fp array<long>) once for every anchor of every block; key names block and anchor."""
    def keys(k: int) -> Column:
        block = F.shiftrightunsigned(F.element_at("fp", k // 2 + 1), 32 * (k % 2)).bitwiseAND(F.lit((1 << 31) - 1))
        return F.transform(anchors(block), lambda a: a.bitwiseOR(F.lit(k << 32)))

    near = F.flatten(F.array(*map(keys, range(blocks))))
    return prints.select("*", F.explode(near).alias("key"))


def _pairs(keys: np.ndarray, prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits apart) of rows with one key and at most `most` bits apart; keys are sorted."""
    at, step = np.arange(len(keys) - 1), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        for part in np.array_split(at, max(1, len(at) >> 18)):
            apart = np.bitwise_count(prints[part] ^ prints[part + step]).sum(1, dtype=np.int64)
            on = np.flatnonzero(apart <= most)
            if len(on):
                yield part[on], part[on] + step, apart[on]
        step += 1


def _forest(keys: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows of each key (sorted by it) as fingerprints u and v, v the first that u reaches at its anchor."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held, n = 0, len(keys)
    for i, j, _ in _pairs(keys, prints.view(np.uint64)[:, None], most):
        a.append(i)
        b.append(j)
        held += len(i)
        if held > 1 << 20:  # a forest stands for what has been found so far
            root = local_roots(n, np.concatenate(a), np.concatenate(b))
            a, b = [np.flatnonzero(root != np.arange(n))], [root[root != np.arange(n)]]
            held = len(a[0])
    root = local_roots(n, np.concatenate(a), np.concatenate(b))
    on = np.flatnonzero(root != np.arange(n))
    return prints[on], prints[root[on]]


def _compare(most: int, hot: int):
    """Links (u, v) at the anchors of a task, whose rows come sorted by key; rows of a hotter anchor are passed on as (u, null, key)."""

    def out(u, v, key) -> pd.DataFrame:
        return pd.DataFrame({"u": u, "v": pd.array(v, "Int64"), "key": pd.array(key, "Int64")})

    def whole(keys: np.ndarray, f: np.ndarray) -> Iterator[pd.DataFrame]:
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        cold = n[back] <= hot
        u, v = _forest(keys[cold], f[cold], most)
        yield out(u, v, [None] * len(u)).drop_duplicates()
        yield out(f[~cold], [None] * int((~cold).sum()), keys[~cold])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = f = np.zeros(0, np.int64)
        passed = None
        for rows in batches:
            keys, f = np.concatenate([keys, rows["key"].to_numpy(np.int64)]), np.concatenate([f, rows["f"].to_numpy(np.int64)])
            if passed is not None and len(keys):
                on = keys == passed
                yield out(f[on], [None] * int(on.sum()), keys[on])
                keys, f = keys[~on], f[~on]
            if not len(keys):
                continue
            done = np.searchsorted(keys, keys[-1])
            yield from whole(keys[:done], f[:done])
            keys, f = keys[done:], f[done:]
            if len(keys) > hot:
                passed = keys[-1]
                yield out(f, [None] * len(f), keys)
                keys = f = np.zeros(0, np.int64)
        yield from whole(keys, f)

    return run


def _second_level(over: DataFrame, most: int, tasks: int) -> DataFrame:
    """(u, v): links of the members (u, key) of hot anchors, by anchors of the halves of the other block."""
    first_block = F.shiftrightunsigned("key", 32) == 0
    block = F.when(first_block, F.shiftrightunsigned("u", 32)).otherwise(F.col("u"))
    half = lambda k: F.transform(anchors(F.shiftrightunsigned(block, 15 * k).bitwiseAND(F.lit((1 << 15) - 1)), 4), lambda a: a.bitwiseOR(F.lit(k << 15)))
    near = over.select("u", "key", F.explode(F.concat(half(0), half(1))).alias("half"))
    # what is still hot is dealt into blocks, each compared with each
    blocks = F.ceil(F.count("*").over(Window.partitionBy("key", "half")) / HOT_ANCHOR)
    dealt = near.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("u"), F.col("blocks")))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = dealt.select(F.xxhash64("key", "half", F.least("mine", "to"), F.greatest("mine", "to")).alias("key"), F.col("u").alias("f"))
    return rows.repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(_compare(most, 1 << 40), "u long, v long, key long").select("u", "v")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(u, v): forests of links between the different fingerprints of `prints` (fp long) at most 3 bits apart."""
    tasks = max(1, math.ceil(prints.count() * 32 / ANCHOR_ROWS))
    spread = anchored(prints.select(F.array("fp").alias("fp")).repartition(tasks), 2).select("key", F.col("fp")[0].alias("f"))
    met = materialize(spread.repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(_compare(BITS_APART, HOT_ANCHOR), "u long, v long, key long"))
    links, over = met.filter("v IS NOT NULL").select("u", "v"), met.filter("v IS NULL").select("u", "key")
    return links if over.isEmpty() else links.unionByName(_second_level(over, BITS_APART, tasks))


def groups(documents: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp long, component_id) of each row: fingerprints of at most 3 differing bits are linked."""
    prints = materialize(fingerprinted(documents, size).select("doc_id", F.col("fp")[0].alias("fp")))
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(own))
    joined = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def jaccard(a: str | None, b: str | None, size: int = SHINGLE) -> float:
    """Similarity of the sets of word shingles; two texts without words are alike."""
    x, y = set(shingle_hashes(words_of(a), size)), set(shingle_hashes(words_of(b), size))
    return len(x & y) / len(x | y) if x or y else 1.0


def _usual(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (hash, count) that repeat in the sample `rows`, the most frequent, by hash.

    They only order the shingles of a text: any one order for all texts finds the same pairs, a good one at less cost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices([len(t) for t in texts], SMALL):
                h = np.array([v for t in texts[a:b] for v in set(shingle_hashes(words_of(t), SHINGLE))], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    got = rows.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(USUAL).toArrow()
    h, n = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def common(n: np.ndarray) -> np.ndarray:
    """How many tokens sets of these sizes must share: one for short ones, a fiftieth of the set for long ones."""
    return np.maximum(1, n // 50)


def shingle_sets(texts: DataFrame, usual: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(same, first, fp, n, s0 to s3, wide, tokens) of (same, first, text): fingerprint, size and sketches of the set of shingles, and its prefix.

    Two sets of similarity 0.8 share at least 0.8 of the larger one, so they share k of the first n - ceil(0.8 n) + k
    shingles (the tokens) in an order common to all, here the rarest first, where k is the lesser `common` of both. A text without words stands for one shingle
    of its own kind. The wide sketch is the parity of the shingles in each of WIDE places: as many bits differ as shingles
    do, or fewer; the other one is folded from it to 256 bits.
    """
    shared = texts.sparkSession.sparkContext.broadcast(usual)  # at most USUAL rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            part = batch.column(2).to_pylist()
            for a, b in slices([len(t) for t in part], SMALL):
                lists = [shingle_hashes(words_of(t), SHINGLE) for t in part[a:b]]
                prints = majority(lists, 1)[:, 0]
                each = [set(x) for x in lists]
                sizes = np.array([len(x) for x in each])
                h = np.array([v for x in each for v in x or (0,)], np.uint64)
                held = np.maximum(sizes, 1)
                starts = np.cumsum(held) - held
                doc = np.repeat(np.arange(len(each)), held)
                count = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    count = np.where(known[at] == h, often[at], 0)
                order = np.lexsort((h, count, doc))
                first = held - (4 * held + 4) // 5 + common(held)
                tokens = h[order][np.arange(len(h)) - starts[doc] < first[doc]]
                place = (mix(h) >> np.uint64(54)).astype(np.int64)
                odd = np.bincount(doc * WIDE + place, minlength=WIDE * len(each)).reshape(-1, WIDE) & 1
                wide = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                sketch = np.bitwise_xor.reduce(wide.reshape(len(each), -1, 4), axis=1)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]), pa.int32()), pa.array(tokens.view(np.int64)))
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(prints.view(np.int64)), pa.array(sizes.astype(np.int64)), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)), pa.array(list(wide), pa.list_(pa.int64())), tokens]
                yield pa.RecordBatch.from_arrays(columns, names=["same", "first", "fp", "n", "s0", "s1", "s2", "s3", "wide", "tokens"])

    return texts.mapInArrow(run, "same binary, first long, fp long, n long, s0 long, s1 long, s2 long, s3 long, wide array<long>, tokens array<long>")


def _across(keys: np.ndarray, label: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one key and of different labels; rows are sorted by key and label."""
    if not len(keys):
        return
    place = np.arange(len(keys))
    new_key = np.append(keys[1:] != keys[:-1], True)
    new_run = new_key | np.append(label[1:] != label[:-1], True)
    key_end = np.flatnonzero(new_key)[np.cumsum(new_key) - new_key] + 1
    run_end = np.flatnonzero(new_run)[np.cumsum(new_run) - new_run] + 1
    for a, b in slices(key_end - run_end + 1, most):
        n = (key_end - run_end)[a:b]
        ends = np.cumsum(n)
        yield np.repeat(place[a:b], n), np.arange(ends[-1]) + np.repeat(run_end[a:b] - ends + n, n)


def _counted(u: np.ndarray, v: np.ndarray, k: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with the sum of shared; k is the same wherever a pair stands."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)])
    return u[first], v[first], k[order[first]], np.add.reduceat(shared[order], first) if len(first) else shared


def _unjoined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v, k, shared): pairs of different labels at the keys of a task whose sizes and sketches allow a similarity of 0.8.

    shared counts keys where they meet, k how many there must be over all tasks; a pair may come more than once, so that
    a task holds no more than PAIRS of them, and the sum of shared counts. Where rows have wide sketches (w0, w1, ...), what
    the narrow ones allow is held against these, so that of a family of texts a little too far apart few pairs go on.
    """
    given = list(batches)
    if not given:
        return
    rows = pd.concat(given, ignore_index=True).sort_values(["key", "label"], kind="stable")
    keys, label, ids, n = (rows[c].to_numpy() for c in ("key", "label", "node", "n"))
    sketch = rows[["s0", "s1", "s2", "s3"]].to_numpy().view(np.uint64)
    wide = rows[[c for c in rows.columns if c.startswith("w")]].to_numpy(np.int64).view(np.uint64)
    block, own, least = rows["block"].to_numpy(), rows["same"].to_numpy(), common(n)
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pd.DataFrame:
        u, v, k, shared = _counted(*map(np.concatenate, zip(*held, strict=True)))
        return pd.DataFrame({"u": u, "v": v, "k": k, "shared": shared})

    for i, j in _across(keys, label):
        on = (own[i] | (block[i] != block[j])) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
        i, j = i[on], j[on]
        # similarity 0.8 means that at most a ninth of both sizes together differs
        for bits in (sketch, wide):
            on = 9 * np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= n[i] + n[j]
            i, j = i[on], j[on]
        if not len(i):
            continue
        a, b = ids[i], ids[j]
        held.append((np.maximum(a, b), np.minimum(a, b), np.minimum(least[i], least[j]), np.ones(len(a), np.int64)))
        if sum(len(x[0]) for x in held) >= PAIRS:
            # pairs repeat over the tokens: what is merged goes on while it is small
            held = [_counted(*map(np.concatenate, zip(*held, strict=True)))]
            if 2 * len(held[0][0]) >= PAIRS:
                yield out()
                held = []
    if held:
        yield out()


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each of the `keys` of a row, its wide sketch and the narrow one that is folded from it as columns."""
    for rows in batches:
        times = rows["keys"].map(len).to_numpy()
        wide = np.stack(rows["wide"].to_list()).astype(np.int64) if len(rows) else np.zeros((0, WIDE // 64), np.int64)
        narrow = np.bitwise_xor.reduce(wide.reshape(len(rows), -1, 4), axis=1)
        each = {c: np.repeat(rows[c].to_numpy(), times) for c in ("node", "label", "block", "same", "n")}
        each |= {f"{c}{k}": np.repeat(bits[:, k], times) for c, bits in (("s", narrow), ("w", wide)) for k in range(bits.shape[1])}
        yield pd.DataFrame({**each, "key": np.concatenate([np.zeros(0, np.int64), *rows["keys"]]).astype(np.int64)})


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _unjoined(_opened(batches))


def _shared_tokens(sets: DataFrame) -> DataFrame:
    """(token, node, n, members) of the tokens that several nodes have; a token's rows stay rows, however many."""
    every = sets.select("node", "n", F.explode("tokens").alias("token"))
    return every.withColumn("members", F.count("*").over(Window.partitionBy("token"))).filter("members > 1")


def _labelled(met: DataFrame, label: DataFrame) -> DataFrame:
    return met.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _allowed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and wide sketches allow a similarity of 0.8: at most a ninth of both sizes together differs."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("wide").alias(f"{side}_wide"))
    met = pairs.join(of("u"), "u").join(of("v"), "v")
    apart = F.aggregate(F.zip_with("u_wide", "v_wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    sizes = 5 * F.least("u_n", "v_n") >= 4 * F.greatest("u_n", "v_n")
    return met.filter(sizes & (9 * apart <= F.col("u_n") + F.col("v_n"))).select("u", "v")


def _kin(met: DataFrame, label: DataFrame, other: Column) -> DataFrame:
    """(u, v): each node and the KIN ones that `other` names at most of its tokens, where labels differ."""
    apart = _labelled(met, label).withColumn("other", other).filter(F.col("label") != F.col("other.label"))
    often = apart.groupBy(F.col("node").alias("u"), F.col("other.node").alias("v")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "v"))
    return often.withColumn("rank", rank).filter(F.col("rank") <= KIN).select("u", "v")


def _to_smallest(met: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the smallest node at a token."""
    return _kin(met, label, F.min(F.struct("node", "label")).over(Window.partitionBy("token")))


def _to_previous(met: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the node before at a token, by size of the set: one that is most alike in size."""
    return _kin(met, label, F.lag(F.struct("node", "label")).over(Window.partitionBy("token").orderBy("n", "node")))


def _rest(met: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): every possible pair of nodes that share a token and have different labels."""
    return _candidates(met, label, sets).groupBy("u", "v", "k").agg(F.sum("shared").alias("shared")).filter("shared >= k").select("u", "v")


def _candidates(met: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, k, shared): what the tasks say of the pairs of nodes of different labels at their tokens.

    Tokens of one smallest node have mostly the same nodes, so they go to one task (to several where they are many), which
    tells a pair once for all of them, and gets a node's sketch once.
    """
    # a token whose documents are one group already says nothing new
    at = Window.partitionBy("token")
    met = _labelled(met, label).withColumns({"low": F.min("label").over(at), "high": F.max("label").over(at), "home": F.min("node").over(at)}).filter("low < high")
    # a token of many documents is dealt into blocks, each compared with each
    blocks = F.ceil(F.col("members") / HOT)
    dealt = met.withColumns({"block": F.pmod(F.xxhash64("node"), blocks), "blocks": blocks}).select("token", "home", "node", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"))
    ends = F.least("block", "to"), F.greatest("block", "to")
    dealt = dealt.select("node", "label", "block", (F.col("block") == F.col("to")).alias("same"), F.xxhash64("token", *ends).alias("key"), F.xxhash64("home", *ends).alias("home"))
    spread = materialize(dealt)
    tasks = max(1, math.ceil(spread.count() / TOKEN_ROWS))
    large = spread.groupBy("home").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")).filter("parts > 1")
    part = F.pmod("key", F.coalesce("parts", F.lit(1)))
    rows = spread.join(large, "home", "left").withColumn("part", part).groupBy("home", "part", "node", "label", "block", "same").agg(F.collect_list("key").alias("keys"))
    whole = rows.join(sets.select("node", "n", "wide"), "node")
    return whole.repartition(tasks, "home", "part").mapInPandas(_told, "u long, v long, k long, shared long")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of a similarity of 0.8 or more, by their texts (same, text); the partners of a v are dealt out by SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = None, set()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != known:
                    known, other = b, set(shingle_hashes(words_of(b), SHINGLE))
                own = set(shingle_hashes(words_of(a), SHINGLE))
                keep.append(5 * len(own & other) >= 4 * len(own | other))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    name = lambda node, same: sets.select(F.col("node").alias(node), F.col("same").alias(same))
    shares = F.ceil(F.count("*").over(Window.partitionBy("v")) / SHARE)
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), shares))
    named = materialize(dealt.join(name("u", "us"), "u").join(name("v", "vs"), "v").select("u", "v", "us", "vs", "salt"))
    left = named.join(texts.select(F.col("same").alias("us"), F.col("text").alias("a")), "us").select("v", "salt", "u", "a")
    right = named.select("v", "vs", "salt").distinct().join(texts.select(F.col("same").alias("vs"), F.col("text").alias("b")), "vs").select("v", "salt", "b")
    return left.join(right, ["v", "salt"]).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _id() -> Column:
    return F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63)))


def _text() -> Column:
    return F.coalesce(F.col("row.text").cast("string"), F.lit(""))


def _keyed(documents: DataFrame) -> DataFrame:
    """(row, id, text, same): the whole row, its id (null as the smallest long), its text, and the digest of that without case."""
    rows = documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row"))
    return rows.select("row", _id().alias("id"), _text().alias("text"), F.unhex(F.sha2(F.translate(_text(), _UPPER.decode(), _LOWER.decode()), 256)).alias("same"))


def _near(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(same, first, row) of each different text, and (same, component_id, least) with the smallest document of its near group.

    Equal texts are one from the start, combined before the shuffle that deals texts out by digest; that table is
    written in buckets, since the verifications and the result take texts from it without moving them. First SimHash
    anchors link fingerprints, and each member of a group is verified against the group's root. What is apart is then
    held against the smallest document, then against the one next in size, at most of its tokens, which joins
    families of copies by few pairs a document. What is still apart is held against every document that shares as many tokens as every pair of the required similarity
    does: no link is lost to SimHash or to the order of the rounds.
    """
    least = F.min_by("row", F.struct("id", F.xxhash64("text")))
    rows = bucketed(_keyed(documents).groupBy("same").agg(F.min("id").alias("first"), least.alias("row")), "same")
    texts = rows.select("same", "first", _text().alias("text"))
    share = max(1, rows.count() // SAMPLE)
    usual = _usual(texts.filter(F.pmod(F.xxhash64("same"), F.lit(share)) == 0))
    sets = materialize(shingle_sets(texts, usual).withColumn("node", F.monotonically_increasing_id()))
    prints = sets.groupBy("fp").agg(F.min("node").alias("node"))
    of = lambda side: prints.select(F.col("fp").alias(side), F.col("node").alias(f"{side}_node"))
    links = fingerprint_links(prints).join(of("u"), "u").join(of("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    equal = sets.select("fp", F.col("node").alias("u")).join(prints.withColumnRenamed("node", "v"), "fp").filter("u <> v").select("u", "v")
    grouped = components(links.unionByName(equal)).filter("node <> root").toDF("u", "v")
    links = materialize(_verified(grouped, sets, texts))
    met = materialize(_shared_tokens(sets))
    for find in (_to_smallest, _to_previous, _rest):
        found = find(met, components(links).toDF("node", "label"), sets)
        more = _verified(_allowed(found, sets), sets, texts)
        links = materialize(links.unionByName(more))
    roots = components(links)
    named = sets.select("node", "same", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct("first", "same")).alias("least"))
    return rows, named.join(least, "root").select("same", F.col("least.first").alias("component_id"), F.col("least.same").alias("least"))


def near_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, component_id): documents whose five-word shingles have Jaccard similarity 0.8 or more are one group."""
    members = _keyed(documents).select(F.col("id").alias("doc_id"), "same").distinct()
    return members.join(_near(documents)[1], "same").select("doc_id", "component_id")


def representatives(documents: DataFrame) -> DataFrame:
    """The document of the smallest id of each near group, with all its columns (repeated rows of it once).

    Members are known by their texts, so documents without an id, or of one id, stand for themselves.
    """
    rows, named = _near(documents)
    kept = named.filter(F.col("same") == F.col("least")).select("same")
    return rows.join(kept, "same", "left_semi").select("row.*")
