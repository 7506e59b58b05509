"""Operators 11 to 13 against SQL and brute force, with odd tables."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import cell_codes, credential_links, joint_counts, queries, statements

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(statements.SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), duck.sql(statements.SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    at = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


# ---- codes -------------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks by comparing each part with each entry, in Python's integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((i, v) for i, v in kept if i is not None)[:entries]
    w = len(seeds[0][1]) // parts
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)]
    books = [[cut(v)[p] for _, v in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            for p, x in enumerate(cut(v)):
                members[p, near(x, books[p])[1]].append(x)
        for (p, k), xs in members.items():
            books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out = [(i, [near(x, books[p]) for p, x in enumerate(cut(v))]) for i, v in kept]
    return sorted((repr(i), "".join(f"{k:02x}" for _, k in n), min(sum(d for d, _ in n), (1 << 63) - 1)) for i, n in out), books


def _vectors(seed, n, width, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "n"), [(0.2, 300), (1e7, 60), (1e25, 40)])
def test_codes_equal_brute_force(spark, spread, n):
    rows = _vectors(3, n, 8, spread)
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[4][1]), (700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, [0.0] * 8)]
    table = spark.createDataFrame([(i, v, (i or 0) % 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    want, books = brute_codes(rows, 2, 32, 3, 1024)
    assert sorted((repr(r.vec_id), r.code, r.error) for r in cell_codes.report(table, 2, 32, 3).collect()) == want
    assert cell_codes.report(table, 2, 32, 3).first().codebooks_sha256 == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_label_errors_of_many_labels(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7)] * 4, None if i % 5 == 0 else i % 4) for i in range(200)], "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, cell_codes.report(rows, 2, 4, 1).collect()))
    monkeypatch.setattr(cell_codes, "LABELS", 0)
    assert sorted(map(tuple, cell_codes.report(rows, 2, 4, 1).collect())) == want


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert cell_codes.report(spark.createDataFrame([], schema)).count() == 0
    none = cell_codes.report(spark.createDataFrame([(None, [1.0] * 8, None), (1, [1.0] * 7, "a"), (2, [], "a")], schema)).collect()
    assert len(none) == 3 and all(r.code is None and r.error is None for r in none)
    mixed = spark.createDataFrame([(3, [1.0] * 8, "a"), (1, [1.0] * 7, "a"), (4, [2.0] * 4, None), (5, [0.5] * 8, None)], schema)
    assert {r.vec_id: r.code for r in cell_codes.report(mixed).collect()} == {1: None, 3: "00000000", 4: None, 5: "01010101"}


def test_filter_passes_most_entries_over():
    r = np.random.default_rng(1)
    book = cell_codes.Book((r.normal(size=(256, 16)) * 128).astype(np.int64))
    x = (r.normal(size=(2000, 16)) * 128).astype(np.int64)
    code, error = book.nearest(x)
    apart = ((x[:, None] - book.entries[None]) ** 2).sum(2)
    assert (code == apart.argmin(1)).all() and (error == apart.min(1)).all()
    assert book.refined < 2000 * 256 / 6


# ---- divergence --------------------------------------------------------------------------------------------------------


def brute_divergence(rows, least=3, ranks=200):
    count, seen, groups = collections.Counter(), collections.defaultdict(set), set()
    for r, (text, lang, source) in enumerate(rows):
        groups.add((lang or "", source or ""))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
            count[lang or "", source or "", t] += 1
            seen[lang or "", t].add(r)
    out = []
    for lang, source in groups:
        kept = [t for (x, t), d in seen.items() if x == lang and len(d) >= least]
        mine = sorted(s for x, s in groups if x == lang)
        total = {s: sum(count[lang, s, t] for t in kept) for s in mine}
        p = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(sum(f(p(count[lang, source, t], total[source]), p(count[lang, s, t], total[s])) for t in kept), s) for s in mine if s != source]
        own = [(p(count[lang, source, t], total[source]), p(sum(count[lang, s, t] for s in mine), sum(total.values())), t) for t in kept if count[lang, source, t]]
        terms = [(f(a, b), t) for a, b, t in own if a > b]
        for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
            ordered = sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


def _texts(seed, n):
    r = random.Random(seed)
    words = ["Été", "der", "The", "the", "naïve", "x", "日本", "don", "t", "É", "zz", "qua"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    say = lambda: "".join(r.choice(words) + r.choice([" ", "7", "_", "'", "\n"]) for _ in range(r.randrange(30)))
    return [(say(), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None, ""])) for _ in range(n)]


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = _texts(2, 200) + [(None, "en", "a"), ("", "en", "silent"), ("the the", "xx", "one"), ("other", "xx", "two"), ("!!", "yy", "alone")] + [("Common line of all", "en", "a")] * 50
    table = spark.createDataFrame([(*v, 1, "z") for v in rows], "text string, lang string, source string, n long, term string").repartition(5)
    want = brute_divergence(rows)
    assert sorted(map(tuple, joint_counts.report(table).collect())) == want
    for name, value in (("TOGETHER", 64), ("PAIRS", 3), ("HELD", 4), ("GROUPS", 0)):
        monkeypatch.setattr(joint_counts, name, value)
    assert sorted(map(tuple, joint_counts.report(table).collect())) == want


def test_divergence_of_an_empty_table(spark):
    assert joint_counts.report(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_histograms_count_every_word_once(spark):
    rows = _texts(4, 120)
    table = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = joint_counts.kept_counts(joint_counts.word_counts(table)).cache()
    groups = joint_counts.group_totals(table, kept).cache()
    words = {(r.lang): r.words for r in groups.collect()}
    sums = joint_counts.histograms(kept, groups).groupBy("lang", "a_source", "b_source").agg(F.sum("m").alias("m"), F.min("m").alias("least")).collect()
    assert sums and all(r.m == words[r.lang] and r.least >= 0 for r in sums)


# ---- secrets -----------------------------------------------------------------------------------------------------------

A, K = "AKIA" + "Q7" * 8, "Zx9" * 12
TEXTS = [
    None, "", "nothing to see", f"token = '{'a1' * 10}' and more", f'PassWord:"{"x" * 11}" then api_key={"y" * 12}', "token=secret:abcdefghijklmnop", "token==" + "q" * 12, f"é日本 {A} {'0af' * 6}",
    "secretpassword: " + "p" * 20 + " passwd : " + "r" * 13, "ſecret=" + "s" * 20 + " toKen=" + "k" * 20, A[:17] + "!" + A[:18], "AKIA" * 6, "g" + "f" * 16 + "g" + "0" * 15,
    f"username=alice {K} https://db.example.com:5432/x", f"username=alice {'.' * 300}{K} https://db.example.com", f"{K} alone https://x.y", f"https://only.example {A}", f"login: bob token={'d' * 16} https://h",
    f"{K} " * 40 + "client_id = web-1", f"api_key={K} {A}",
]


def brute_spans(text, scope=200):
    text = text or ""
    keys = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    names = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("access_?key_?id", "client_?id", "account_?id", "username", "login")) + ")"
    parts = [("assign", *m.span()) for m in re.finditer(keys + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    parts += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    weak = [("identifier", *m.span()) for m in re.finditer(names + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", text) if len(m[1]) >= 4]
    weak += [("mixed", *m.span()) for m in re.finditer(r"[A-Za-z0-9+/_-]+", text) if len(m[0]) >= 24 and all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    weak += [("endpoint", *m.span()) for m in re.finditer(credential_links.ENDPOINT, text)]
    ids, secrets = ("access", "identifier"), ("assign", "hex", "mixed")
    near = lambda w, kinds: any(k in kinds and max(a, w[1]) - min(z, w[2]) <= scope for k, a, z in parts + weak)
    free = lambda w: not any(a <= w[1] < z for _, a, z in parts)
    rule = {"identifier": lambda w: near(w, secrets), "mixed": lambda w: near(w, ids) and free(w), "endpoint": lambda w: near(w, ids) and near(w, secrets)}
    order = lambda found: ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(found, key=lambda s: (s[1], credential_links.KINDS.index(s[0]))))
    n = [sum(k == x for k, _, _ in parts) for x in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(order(parts).encode()).hexdigest(), order(parts + [w for w in weak if rule[w[0]](w)]))


def test_secrets_equal_brute_force(spark):
    r = random.Random(8)
    pieces = ["token", "Secret", "=", ":", " ", "'", "AKIA", "username", K, "0123456789abcdef", "https://a.b", "\n", "é", "x" * 12, "API_KEY", "_", ".", " " * 150, "login=root"]
    texts = TEXTS + ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(300)]
    table = spark.createDataFrame([(None if i % 50 == 3 else i // 2, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, kind string, row long").repartition(4)
    got = sorted(repr(tuple(v)) for v in credential_links.report(table).collect())
    assert got == sorted(repr((None if i % 50 == 3 else i // 2, *brute_spans(t))) for i, t in enumerate(texts))
    assert any("endpoint" in brute_spans(t)[-1] for t in TEXTS) and any("mixed" in brute_spans(t)[-1] for t in TEXTS)


def test_secrets_of_long_and_empty_tables(spark):
    long = "deadbeef" * 2 + " "
    text = (long * 20_000) + "username=abcd"
    got = credential_links.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(v.doc_id, v.n_hex) for v in got] == [(1, 20_000)] and got[0].spans.endswith(f",identifier:{len(text) - 13}:{len(text)}")
    assert credential_links.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_run_without_python(spark):
    plan = credential_links.report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
