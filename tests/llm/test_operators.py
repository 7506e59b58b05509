"""The corpus operators against brute force, round trips and held-out accuracy, with odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymill.llm import chat_format, components, cost_packing, merge_automaton, neighbour_toxicity, norm_search, paragraph_sketch, queries, run_index, simhash_anchors, subword_quality, word_language

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string"
random.seed(5)
_WORDS = ["".join(random.choice("aeioustrn") for _ in range(random.randrange(2, 9))) for _ in range(400)]
LONG = " ".join(random.choice(_WORDS) for _ in range(6000)) + "."
ODD = [
    (1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \t\n", "en", "a", 3, "g"), (4, LONG, "en", "a", None, "q"), (5, LONG, "en", "a", None, "q"), (5, LONG, "en", "a", None, "q"),
    (6, LONG[:900] + " ünï ✓ " + LONG[900:1500], "de", None, 1, "y"), (None, "no id here", "fr", "b", 2, "z"), (8, "short", None, "b", 2, "z"), (9, "a" * 400, "en", "b", 2, None), (10, "1234 !!! ...", "en", "b", 2, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def brute_removal(rows, length=100):
    seen, out = set(), {}
    for key, raw in rows:
        covered = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if (w := raw[s : s + length]) in seen:
                covered[s : s + length] = True
            seen.add(w)
        runs = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        out[key] = (len(raw), int(covered.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(raw, covered) if not c)).hexdigest())
    return out


def test_removal_is_exact(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, SF).collect()}
    assert got == brute_removal(sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect()))


def test_removal_of_hot_keys_is_exact(spark, docs, monkeypatch):
    monkeypatch.setattr(run_index, "HOT_KEY", 2)
    monkeypatch.setattr(run_index, "GROUP_BYTES", 1 << 16)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run_index.report(docs).collect()}
    assert got == brute_removal(sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect()))


def test_removal_on_odd_tables(spark, odd, empty):
    got = collections.defaultdict(list)
    for r in run_index.report(odd).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    rows = {(-(1 << 63) if i is None else i): (t or "").encode() for i, t, *_ in ODD}
    want = brute_removal(sorted(rows.items()))
    assert len(got[5]) == 2 and all(set(v) == {want[-(1 << 63) if k is None else k]} for k, v in got.items())
    assert run_index.report(empty).count() == 0
    cut = run_index.dedup(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD) and {r.doc_id: r.text for r in cut.collect()}[5] == ""


def test_run_index_alone():
    segments = [b"abcabcabcabc", b"xxabcabcyy", b"abcabcabcabc"]
    again = run_index.RunIndex(segments).repeats(6)
    whole, seen, want = b"\0".join(segments) + b"\0", set(), []
    for s in range(len(whole)):
        w = whole[s : s + 6]
        ok = len(w) == 6 and b"\0" not in w
        want.append(ok and w in seen)
        if ok:
            seen.add(w)
    assert again.tolist() == want


def test_language_held_out(spark, docs, odd, empty):
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SF).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in got)
    assert np.mean([got[i].lang_pred == want[i] for i in held]) > 0.95
    model = word_language.fit(docs)
    rows = {r.doc_id: r for r in word_language.annotate(odd, model).collect()}
    assert all((rows[i].lang_pred, rows[i].lang_score) == ("und", 0.0) for i in (1, 2, 3, 10)) and rows[5].h == "q"
    assert word_language.annotate(empty, model).count() == 0 and word_language.annotate(odd, word_language.fit(empty)).count() == len(ODD)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    scores, moves, sizes = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([4, 1, 4])
    starts = np.array([0, 4, 5])
    gamma, pairs = word_language.forward_backward(scores, moves, starts, sizes, True)
    want, moved = np.zeros((9, 3)), np.zeros((3, 3))
    for a, n in zip(starts, sizes):
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        w = np.exp([sum(scores[a + t, p[t]] for t in range(n)) + sum(moves[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            for t in range(n):
                want[a + t, p[t]] += x
            for t in range(n - 1):
                moved[p[t], p[t + 1]] += x
    assert np.allclose(gamma, want) and np.allclose(pairs, moved)


def plain_fingerprint(text, size=3):
    """The contract's fingerprint, word for word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_groups(spark, docs, odd, empty):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_dedup(spark, SF).collect()}
    assert {i: f for i, (f, _) in got.items()} == {r.doc_id: f"{plain_fingerprint(r.text):016x}" for r in docs.collect()}
    ids = sorted(got)
    f = np.array([int(got[i][0], 16) for i in ids], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1))
    root = components.local_roots(len(ids), a, b)
    assert all(got[i][1] == ids[root[k]] for k, i in enumerate(ids))
    rows = simhash_anchors.groups(odd).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i, *_ in ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and {by[i].component_id for i in (1, 2, 3)} == {1} and by[5].component_id == 4
    assert by[None].component_id is None and simhash_anchors.groups(empty).count() == 0
    twins = simhash_anchors.groups(spark.createDataFrame([(None, "a b c"), (3, "A b c"), (3, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in twins) == [(0, 3), (3, 3), (3, 3)]


def test_hot_anchors_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_anchors, "HOT_ANCHOR", 8)
    rng = random.Random(21)
    base = rng.getrandbits(64)
    # one first block for all, so all meet at its anchors; their other halves differ widely, in families
    heads = [(base & ((1 << 31) - 1)) | rng.getrandbits(33) << 31 for _ in range(40)]
    prints = sorted({h ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for h in heads for _ in range(6)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash_anchors.fingerprint_links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"))
    got = {r.node: r.root for r in components.components(links).collect()}
    f = np.array(prints, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1))
    root = components.local_roots(len(f), a, b)
    want = collections.defaultdict(set)
    for k, x in enumerate(prints):
        want[root[k]].add(signed(x))
    found = collections.defaultdict(set)
    for x in prints:
        found[got.get(signed(x), signed(x))].add(signed(x))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_anchors_cover(spark):
    rng = random.Random(2)
    words = [rng.getrandbits(31) for _ in range(200)]
    rows = [(w, w ^ (1 << rng.randrange(31) if rng.random() < 0.8 else 0)) for w in words]
    got = spark.createDataFrame(rows, "a long, b long").select(simhash_anchors.anchors(F.col("a")).alias("x"), simhash_anchors.anchors(F.col("b")).alias("y"), "a").collect()
    for r in got:
        assert set(r.x) & set(r.y) and len(r.x) <= 16 and all((w ^ r.a).bit_count() <= 2 for w in r.x)


def test_all_close_fingerprints_meet(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([([signed(x)], signed(x)) for x in base + near], "fp array<long>, f long").distinct()
    got = collections.defaultdict(set)
    for r in simhash_anchors.anchored(rows, 2).collect():
        got[r.f].add(r.key)
    every = base + near
    assert all(got[signed(x)] & got[signed(y)] for x in every for y in every if (x ^ y).bit_count() <= 3)


def test_near_groups(spark, docs):
    got = {r.doc_id: r.component_id for r in simhash_anchors.near_groups(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [set(simhash_anchors.shingle_hashes(simhash_anchors.words_of(t), 5)) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components.local_roots(len(rows), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    assert all(got[i] == rows[root[k]][0] for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("n", [1, 7, 40])
def test_components(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(50), rng.randrange(50)) for _ in range(n)] + [(k, k + 1) for k in range(100, 130)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = components.local_roots(200, np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert all(got.get(k, k) == root[k] for k in range(200))


def test_toxicity(spark, docs, odd, empty):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [i for i in labels if i in got and got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.9 and all(0 <= r.score <= 1 for r in got.values())
    model = neighbour_toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert neighbour_toxicity.annotate(odd, model).count() == len(ODD)
    none = neighbour_toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.toxic_score for r in neighbour_toxicity.annotate(odd, none).collect()} == {0.0}


def plain_neighbours(model, texts, examples, k):
    """Every cosine of dense TF-IDF rows over the whole vocabulary."""
    def dense(rows):
        out = np.zeros((len(rows), neighbour_toxicity.TERMS), np.float32)
        for i, t in enumerate(rows):
            doc, term, n = neighbour_toxicity.counts([t])
            out[i, term] = (1 + np.log(n)) * model.weights[term]
        size = np.sqrt((out.astype(np.float64) ** 2).sum(1, keepdims=True))
        return out / np.where(size > 0, size, 1)

    return -np.sort(-(dense(texts) @ dense(examples).T), 1)[:, :k]


def test_nearest_examples_are_exact(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = neighbour_toxicity.fit(docs, labels)
    by = {r.doc_id: r.text for r in docs.collect()}
    texts, examples = [t or "" for t in by.values()], [by[i] for i in model.ids]
    doc, term, weight = neighbour_toxicity.vectors(texts, model.weights)
    near, value, _ = model.index.nearest(doc, term, weight, len(texts))
    assert 0 < model.labels.sum() < len(model.labels) == len(examples)
    assert np.allclose(value, plain_neighbours(model, texts, examples, near.shape[1]), atol=1e-5)
    df = collections.Counter(t for text in texts for t in set(neighbour_toxicity.counts([text])[1].tolist()))
    built = neighbour_toxicity.build(examples, model.labels.astype(int), model.ids, np.array([df[t] for t in range(neighbour_toxicity.TERMS)]), len(texts))
    assert np.allclose(built.weights, model.weights)  # document frequencies are those of all documents


def test_blocks_out_of_reach_are_passed_over(monkeypatch):
    monkeypatch.setattr(neighbour_toxicity, "BLOCK", 16)
    rng = random.Random(12)
    topics = [["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(30)] for _ in range(20)]
    texts = [" ".join(rng.choices(topics[k % 20], k=12) + rng.choices(topics[(k + 1) % 20], k=1)) for k in range(640)]
    model = neighbour_toxicity.build(texts, np.array([k % 2 for k in range(640)]), np.arange(640), np.ones(neighbour_toxicity.TERMS), 640)
    doc, term, weight = neighbour_toxicity.vectors(texts[:100], model.weights)
    near, value, opened = model.index.nearest(doc, term, weight, 100, k=3)
    assert opened < 0.5 * 100 * 40 and np.allclose(value, plain_neighbours(model, texts[:100], [texts[i] for i in model.ids], 3), atol=1e-5)


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.normal(size=6) * rng.choice([0.1, 1, 3])]) for k in range(0, 400, 5)]
    rows += [(1000, None), (1050, [float("nan")] * 6), (1100, [None] * 6), (1150, []), (50, rows[3][1]), (1200, [0.0] * 6)]
    got = collections.defaultdict(list)
    for r in norm_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for q, _ in good:
        if q % 50 == 0 and q != 50:
            x = next(v for i, v in good if i == q)
            want = sorted((-int(x @ v), i) for i, v in good if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert norm_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pruned_search_is_whole():
    rng = np.random.default_rng(8)
    p, q = rng.integers(-90, 90, (600, 8)), rng.integers(-90, 90, (20, 8))
    s = q @ p.T
    floors = np.sort(s, 1)[:, -5].astype(float)
    got = norm_search.search(pd.DataFrame({"id": 10_000 + np.arange(20), "v": list(q), "floor": floors}), pd.DataFrame({"id": np.arange(600), "v": list(p)}), 5)
    for k in range(20):
        assert sorted(got[got.query_id == 10_000 + k].score.tolist()) == np.sort(s[k])[-5:].tolist()


def test_search_prunes_for_each_query():
    rng = np.random.default_rng(8)
    p = rng.normal(size=(4000, 16)) * np.exp(rng.normal(size=(4000, 1)) * 1.5) * 40
    q = rng.normal(size=(300, 16)) * 40
    p, q = np.floor(p).astype(np.int64), np.floor(q).astype(np.int64)
    s = q @ p.T
    floors = np.sort(s, 1)[:, -5].astype(float)
    done = []
    bucket = pd.DataFrame({"id": np.arange(4000), "v": list(p)})
    got = norm_search.search(pd.DataFrame({"id": 10_000 + np.arange(300), "v": list(q), "floor": floors}), bucket, 5, done)
    assert sum(done) < 0.2 * s.size
    for k in range(300):
        assert sorted(got[got.query_id == 10_000 + k].score.tolist()) == np.sort(s[k])[-5:].tolist()
    # vectors of one length: only the coordinate can tell
    u = np.floor(400 * p / np.maximum(np.sqrt((p**2).sum(1, keepdims=True)), 1)).astype(np.int64)
    near, done = u[:50] + rng.integers(-3, 4, (50, 16)), []
    floors = np.sort(near @ u.T, 1)[:, -1].astype(float)
    got = norm_search.search(pd.DataFrame({"id": 10_000 + np.arange(50), "v": list(near), "floor": floors}), pd.DataFrame({"id": np.arange(4000), "v": list(u)}), 1, done)
    assert sum(done) < 0.2 * 50 * 4000 and sorted(got.score) == sorted(floors)


def test_layers_out_of_reach_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(norm_search, "BUCKET", 200)
    monkeypatch.setattr(norm_search, "BLOCK", 20)
    monkeypatch.setattr(norm_search, "FIRST", 50)
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) * np.exp(rng.normal() * 2)).tolist()) for k in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = norm_search.materialize(norm_search._usable(table, 256, "vec_id", "embedding"))
    queries = norm_search.materialize(norm_search._thresholds(usable, usable.filter("id % 50 = 0"), 5))
    q, p = norm_search.live_pairs(norm_search._layered(usable, 20), queries)
    # all pairs would be 80 queries in 20 buckets and 4,000 vectors in 4 blocks
    assert q.count() < 0.5 * 80 * 20 and p.count() < 0.5 * 4000 * 4
    x = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    got = collections.defaultdict(list)
    for r in norm_search.top_k(table).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i in range(0, 4000, 50):
        want = sorted((-int(x[i] @ v), j) for j, v in x.items() if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]


def test_chat_round_trip(spark):
    texts = ["a", "\\h # < \\b </turn>\n### user: x", "", None, "ünï : \n", "\\\\l"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "assistant", "us:er#", None], texts))]
    table = spark.createDataFrame(rows + [(2, None, "assistant", "first")], "conv_id long, turn long, role string, text string")
    for r in chat_format.read_back(chat_format.formatted(chat_format.from_rows(table))).collect():
        want = [(b or "", t or "") for c, _, b, t in sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: x[1])]
        want = ([("assistant", "first")] if r.conv_id == 2 else []) + want
        assert [(t.role, t.text) for t in r.turns] == want and r.loss_text == "".join(t for b, t in want if b == "assistant")
    assert chat_format.digests(chat_format.formatted(chat_format.from_rows(table.limit(0)))).count() == 0


def test_chat_layouts(spark):
    records = ['{"messages":[{"role":"human","content":"hi"},{"role":"assistant","content":null}],"id":3}', '{"instruction":"a","input":"b","output":"c"}', '{"prompt":"p","completion":"q"}', '{"conversations":[{"from":"gpt","value":"x"}]}', "junk{", None, "[]"]
    got = [(r.layout, [tuple(t) for t in r.turns or []]) for r in chat_format.canonical(spark.createDataFrame([(r,) for r in records], "record string")).collect()]
    assert got[:4] == [("messages", [("user", "hi"), ("assistant", "")]), ("instruction_input", [("user", "a\nb"), ("assistant", "c")]), ("prompt_completion", [("user", "p"), ("assistant", "q")]), ("conversations", [("assistant", "x")])]
    assert all(g == (None, []) for g in got[4:])


def test_chat_layouts_by_all_items_and_most_paths(spark):
    records = [
        '{"messages":[{"role":"assistant","tool":1},{"role":"user","content":"hi"}]}',  # the first item has no content
        '{"messages":[{"role":"user","content":"x"}],"system":"s","prompt":"p"}',  # names that other layouts use
        '{"prompt":"[1, 2]","response":"{}"}',  # texts that look like lists
        '{"prompt":"p","response":"r","system":"s","source":"w"}',
        '{"prompt":"p","completion":"c","response":"r"}',
    ]
    got = [(r.layout, [tuple(t) for t in r.turns or []]) for r in chat_format.canonical(spark.createDataFrame([(r,) for r in records], "record string")).collect()]
    assert got[0] == ("messages", [("assistant", ""), ("user", "hi")]) and got[1] == ("messages", [("user", "x")])
    assert got[2] == ("prompt_response", [("user", "[1, 2]"), ("assistant", "{}")]) and got[3][0] == "system_prompt_response" and got[4][0].startswith("prompt_")


def test_chat_rows_go_through_the_fingerprint(spark):
    rows = [(3, 1, "assistant", "b", "m"), (3, 0, "Human", "a", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, model string")
    (got,) = chat_format.from_rows(table).collect()
    assert got.layout == "turn_rows" and [tuple(t) for t in got.turns] == [("Human", "a"), ("assistant", "b")]
    (other,) = chat_format.from_rows(table.toDF("chat", "index", "role", "content", "content2"), "chat").collect()
    assert other.layout == "content_rows" and other.fingerprint != got.fingerprint
    (known,) = chat_format.canonical(spark.createDataFrame([('{"turns":[{"turn":0,"role":"Human","text":"a"},{"turn":1,"role":"assistant","text":"b"}]}',)], "record string")).collect()
    assert (known.fingerprint, known.layout, known.turns) == (got.fingerprint, got.layout, got.turns)
    with pytest.raises(ValueError):
        chat_format.from_rows(table.select("conv_id", "model"))


def test_sketches(spark, docs, odd, empty):
    got = {r.doc_id: r for r in queries.op7_document_fingerprint(spark, SF).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    for k, (i, t) in enumerate(rows):
        edited = paragraph_sketch.edit(t, rows[(k + 1) % len(rows)][1])
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert paragraph_sketch.fingerprinted(odd).count() == len(ODD) and paragraph_sketch.fingerprinted(empty).count() == 0
    lone = paragraph_sketch.fingerprinted(odd.filter("doc_id = 6")).first()
    assert lone.near_next == 1.0

    def pieces(text):
        return collections.Counter(x for x in re.split(r"[.!?\n]", text) if any(ord(c) > 32 for c in x))

    def like(a, b):
        x, y = pieces(a), pieces(b)
        every = sum((x | y).values())
        return sum((x & y).values()) / every if every else 1.0

    of = collections.defaultdict(set)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = paragraph_sketch.edit(t, following)
        assert got[i].near_next == pytest.approx(like(t, following)) and got[i].near_edited == pytest.approx(like(t, edited))
        of[t].add(got[i].fingerprint)
        of[edited].add(got[i].edited_fingerprint)
    assert all(len(v) == 1 for v in of.values())


def test_next_documents_of_wide_sparse_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(paragraph_sketch, "STRETCH", 200)
    ids = [None] * 30 + [7] * 30 + [-(1 << 63) + 5, (1 << 63) - 1, -3] + [*range(100, 160)]
    table = spark.createDataFrame([(i, f"text {k}.") for k, i in enumerate(ids)], "doc_id long, text string").repartition(5).cache()
    seen = table.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    rows = sorted(seen, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    got = {r.text: r.following for r in paragraph_sketch.with_next(table).collect()}
    assert got == {r.text: rows[(k + 1) % len(rows)].text for k, r in enumerate(rows)}


def test_peeling_recovers_all_differences():
    texts = [". ".join(random.choice(_WORDS) for _ in range(n)) for n in (0, 1, 30, 900)]
    other = [t[: len(t) // 3] for t in texts]
    a, b = paragraph_sketch.digests(texts), paragraph_sketch.digests(other)
    want = [len(set(a[1][a[0] == k].tolist()) ^ set(b[1][b[0] == k].tolist())) for k in range(4)]
    assert paragraph_sketch.differing(a, b, 4).tolist() == want


def test_quality(spark, odd, empty):
    got = {r.doc_id: r for r in queries.op8_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [i for i in labels if i in got and got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.9
    model = subword_quality.train([], [])
    assert {r.quality_score for r in subword_quality.annotate(odd, model).collect()} == {0.5} and subword_quality.annotate(empty, model).count() == 0


def test_packing(spark, odd, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    table = odd.withColumn("doc_id", F.when(F.col("doc_id") == 5, F.monotonically_increasing_id() + 100).otherwise(F.coalesce("doc_id", F.lit(7))))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in cost_packing.packed(table, path).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc, n in sorted(pieces[i]):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert cost_packing.packed(empty, path).count() == 0


def test_automaton_is_the_tokenizer(spark, docs, odd, empty):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path), merge_automaton.automaton(path)
    texts = [r.text or "" for r in docs.limit(60).collect()] + [t or "" for _, t, *_ in ODD] + ["aaaa aaaaa", "x<|endoftext|> y", "½²Ⅷ٣ \x1c\x1d", "日本語🤖 é́", "don't  'S\n\n x"]
    texts += ["".join(random.choice("abc then oise.,!1\n") for _ in range(60)) for _ in range(100)]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert merge_automaton.encoded(odd, path).count() == len(ODD) and merge_automaton.encoded(empty, path).count() == 0


def planted_edits(bands=((0.80, 0.82), (0.82, 0.85), (0.85, 0.90), (0.90, 0.99)), each=40):
    """Pairs of texts, one with a block of words added or replaced, and the exact similarity of each."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    out = []
    for low, high in bands:
        made = 0
        while made < each:
            a = [word() for _ in range(rng.randrange(100, 400))]
            size, at = rng.randrange(1, len(a) // 4 + 2), rng.randrange(len(a))
            b = a + [word() for _ in range(size)] if made % 2 else a[:at] + [word() for _ in range(size)] + a[at + size :]
            s = simhash_anchors.jaccard(" ".join(a), " ".join(b))
            if low <= s < high:
                out.append((" ".join(a), " ".join(b), s))
                made += 1
    return out


def test_all_near_pairs_of_block_edits_are_linked(spark):
    pairs = planted_edits()
    rows = [(2 * k + side, p[side]) for k, p in enumerate(pairs) for side in (0, 1)]
    got = {r.doc_id: r.component_id for r in simhash_anchors.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) == 160 and all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(len(pairs)))


def test_no_near_link_is_lost_in_a_family_of_one_template(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    frame = [word() for _ in range(300)]
    # only the one short text links the long ones; the 40 middle ones are a little less alike to them and crowd it out
    rows = [(k, " ".join(frame + [word() for _ in range(n)])) for k, n in enumerate([60] * 30 + [18] * 40 + [12])]
    sets = [set(simhash_anchors.shingle_hashes(simhash_anchors.words_of(t), 5)) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components.local_roots(len(rows), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    got = {r.doc_id: r.component_id for r in simhash_anchors.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(root.tolist()) == {0} and all(got[i] == rows[root[k]][0] for k, (i, _) in enumerate(rows))


def test_representatives_of_null_and_repeated_ids(spark):
    texts = [" ".join(random.Random(k).choices(_WORDS, k=60)) for k in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[3]), (8, texts[0] + " more"), (3, texts[2] + " more")]
    got = simhash_anchors.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, texts[0]), (0, texts[1]), (3, texts[2] + " more"), (5, texts[3])])


def test_top_k_of_repeated_query_rows_is_the_sqls(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(120)]
    rows += [rows[50], *[rows[100]] * 4, (0, rows[7][1])]
    table = pd.DataFrame(rows, columns=["vec_id", "embedding"])
    table.to_parquet(tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    got = queries.op5_top_k(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(queries.oracle_sql()["op5_top_k"]).fetchall()) and len(got) == 15


def test_packing_query_is_whole(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op9_packing(spark, SF).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {r.doc_id for r in docs.collect()}
    for r in docs.collect():
        ids, at = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc, n in sorted(pieces[r.doc_id]):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_bpe_query_is_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op10_bpe(spark, SF).collect()} == want


def test_arcs_are_correct_pairs():
    own = merge_automaton.automaton(queries.tokenizer_path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    rng, tokens = random.Random(2), [t for t in own.born if own.labels[t].isalpha()]
    short = [t for t in tokens if len(own.labels[t]) <= 3]
    for _ in range(4000):
        a, b = rng.choice(tokens if rng.random() < 0.5 else short), rng.choice(short)
        word = (own.labels[a] + own.labels[b]).decode()
        assert own.arc(a, b) == (library.encode(word, add_special_tokens=False).ids == [a, b])


@pytest.mark.parametrize("name", ["op5_top_k", "op6_chat_format"])
def test_registered_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.queries()[name](spark, SF)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
