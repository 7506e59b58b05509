"""The pipeline's stages: columns, decisions and the pieces at the end, each against brute force on its own input."""

import collections
import random

import corpus_pipeline
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallymill.llm import components, run_index, simhash_anchors, subword_quality, word_language
from tests.llm.test_operators import brute_removal

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {"documents": docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        if k < 4:
            assert docs.columns == columns and docs.count() > 0
    texts = {name: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for name, d in seen.items() if name != "packing"}
    known = {r.doc_id for r in word_language.annotate(seen["documents"], word_language.fit(seen["documents"])).filter("lang_pred <> 'und'").collect()}
    assert set(texts["language_id"]) == known
    model = subword_quality.fit(seen["language_id"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts["quality"]) == {r.doc_id for r in subword_quality.annotate(seen["language_id"], model).filter("quality_score >= 0.5").collect()}
    rows = sorted(texts["quality"].items())
    sets = [set(simhash_anchors.shingle_hashes(simhash_anchors.words_of(t), 5)) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components.local_roots(len(rows), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    assert set(texts["near_dedup"]) == {rows[r][0] for r in root}
    want = brute_removal(sorted((i, (t or "").encode()) for i, t in texts["near_dedup"].items()))
    assert set(texts["suffix_dedup"]) == {i for i, (n, removed, _, _) in want.items() if removed < n or n == 0}
    for i, t in texts["suffix_dedup"].items():
        # a character that is only partly covered stays whole
        assert 0 <= len(t.encode()) - (want[i][0] - want[i][1]) <= 6 * want[i][2]
    sizes = collections.Counter()
    for r in seen["packing"].collect():
        sizes[r.doc_id, r.doc_tokens] += r.length
    assert {i for i, _ in sizes} == set(texts["suffix_dedup"]) and all(n == got for (_, n), got in sizes.items())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "suffix_dedup", "packing"]


def test_cutting_keeps_columns_of_clashing_names(spark):
    text = "".join(random.Random(8).choices("abcdefghij ", k=300))
    rows = [(1, text, "a", 5), (2, "x" + text, "b", 6), (3, text, "c", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __cut_id string, __had long")
    got = {r.doc_id: r for r in run_index.dedup(table).collect()}
    assert table.columns == run_index.dedup(table).columns and [got[k]["__cut_id"] for k in (1, 2, 3)] == ["a", "b", "c"]
    assert (got[1].text, got[3].text) == (text, "") and len(got[2].text) < 10
    assert {r.doc_id for r in run_index.dedup(table, emptied=False).collect()} == {1, 2}


def _through(spark, docs, tmp_path, keep=lambda name, rows: None):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == before
        keep(name, docs)
    return docs


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = docs.collect()
    odd = [(r.doc_id if k % 9 else None, r.text, r.lang, "en", f"q{k}", k / 2, k, "s") for k, r in enumerate(rows)]
    odd += [odd[1], odd[1], (7, None, "en", "x", "q", 0.0, 0, "s"), (None, "", None, "x", "q", 0.0, 0, "s"), (8, " \n\t", "en", "x", "q", 0.0, 0, "s"), (9, rows[3].text * 40, "en", "x", "long", 1.0, 1, "s")]
    table = spark.createDataFrame(odd, "doc_id long, text string, lang string, lang_pred string, quality_score string, lang_score double, same long, row string").repartition(3)
    given = collections.Counter((r.doc_id, r.lang_pred, r.quality_score, r.lang_score, r.same, r.row) for r in table.collect())
    left = {}

    def keep(name, got):
        if name != "packing":
            now = collections.Counter((r.doc_id, r.lang_pred, r.quality_score, r.lang_score, r.same, r.row) for r in got.collect())
            assert not now - given
            left[name] = now

    packed = _through(spark, table, tmp_path, keep)
    assert sum(left["language_id"].values()) > 100 and sum(left["suffix_dedup"].values()) > 10
    assert left["language_id"][odd[1][0], "en", "q1", 0.5, 1, "s"] in (0, 3) and max(left["near_dedup"].values()) == 1
    assert {r.doc_id for r in packed.collect()} == {k[0] for k in left["suffix_dedup"]}


def test_stages_take_an_empty_table(spark, tmp_path):
    table = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, lang_words string")
    assert _through(spark, table, tmp_path).count() == 0


def test_formatting_keeps_columns_of_clashing_names(spark):
    from tallymill.llm import chat_format

    turns = "array<struct<role:string,text:string>>"
    rows = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")], "h", "b", "s")], f"conv_id long, turns {turns}, heads string, bodies string, SIZES string")
    got = chat_format.formatted(rows)
    assert got.columns[: len(rows.columns)] == rows.columns and tuple(got.first())[2:5] == ("h", "b", "s")


def test_candidates_leave_a_task_in_pieces():
    """Pairs of a key of very many documents are given in bounded pieces, and their shared counts sum up to all."""
    n, keys = 700, 2
    node = np.tile(np.arange(n), keys)
    rows = pd.DataFrame({"node": node, "label": node, "block": 0, "same": True, "key": np.repeat(np.arange(keys), n), "n": 100, **{f"s{k}": 0 for k in range(4)}})
    pieces = list(simhash_anchors._unjoined(iter([rows[:500], rows[500:]])))
    assert len(pieces) > 1 and max(map(len, pieces)) <= 2 * simhash_anchors.PAIRS
    got = pd.concat(pieces).groupby(["u", "v", "k"]).shared.sum()
    assert len(got) == n * (n - 1) // 2 and (got == keys).all()
    assert all(u > v for u, v, _ in got.index)
    assert list(simhash_anchors._unjoined(iter([]))) == []


def test_a_family_apart_gives_few_candidates(spark, monkeypatch):
    """Copies of one text a little further apart than 0.8 are told apart in the tasks; the pairs that belong together all come, once a share."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(400), 12):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    for k in range(4):  # and four near ones of the first
        texts.append(texts[0] + f" z{k}")
    each = [set(simhash_anchors.shingle_hashes(simhash_anchors.words_of(t), 5)) for t in texts]
    want = {(i, j) for i in range(64) for j in range(i) if len(each[i] & each[j]) >= 0.8 * len(each[i] | each[j])}
    assert 10 <= len(want) < 150
    rows = spark.createDataFrame([(str(k).encode(), k, t) for k, t in enumerate(texts)], "same binary, first long, text string").coalesce(1)
    usual = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sets = simhash_anchors.shingle_sets(rows, usual).withColumn("node", F.col("first")).cache()
    met = simhash_anchors._shared_tokens(sets)
    label = spark.createDataFrame([], "node long, label long")
    monkeypatch.setattr(simhash_anchors, "TOKEN_ROWS", 300)  # many tasks
    told = simhash_anchors._candidates(met, label, sets).collect()
    assert {(r.u, r.v) for r in told} >= want
    assert len(told) < 3 * len(want) + 300
    for together, hot in ((50_000, 2000), (100, 20)):
        monkeypatch.setattr(simhash_anchors, "TOGETHER", together)
        monkeypatch.setattr(simhash_anchors, "HOT", hot)
        found = simhash_anchors._rest(met, label, sets).collect()
        assert {(r.u, r.v) for r in found} >= want and len(found) == len(set(found))
    one = simhash_anchors._rest(met, label.unionByName(sets.select("node", F.lit(0).cast("long").alias("label"))), sets)
    assert one.count() == 0
