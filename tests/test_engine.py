"""Calendar edges, parsing, lineage, invariants and streaming."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallymill.functions.measures import METRICS
from tallymill.operators import analytics, benefit, calendar, git_output, lineage, pricing, rollup
from tallymill.plans import registry
from tallymill.sources import jsonl, testdata

SF = "/root/testdata/sf0.001"


def test_days_follow_the_clock():
    hours = lambda d, z: (calendar.day_start(date.fromordinal(d.toordinal() + 1), z) - calendar.day_start(d, z)) / 3600
    assert hours(date(2024, 3, 10), "America/New_York") == 23
    assert hours(date(2024, 11, 3), "America/New_York") == 25
    assert hours(date(2024, 4, 7), "Australia/Lord_Howe") == 24.5
    assert len(calendar.segments(calendar.day_start(date(2024, 1, 1), "Asia/Kathmandu"), calendar.day_start(date(2024, 1, 2), "Asia/Kathmandu"))) == 3
    assert calendar.week_start(date(2024, 3, 13), 0) == date(2024, 3, 11) and calendar.week_start(date(2024, 3, 13), 6) == date(2024, 3, 10)


@pytest.mark.parametrize(("start", "end"), [(0, 0), (60, 3540), (60, 3660), (3600, 7200), (-7260, 7260), (1800, 90_060)])
def test_segments_cover_once(start, end):
    minutes = [m for s in calendar.segments(start, end) for m in range(s.start, s.end, 60)]
    assert minutes == list(range(start, end, 60))


@pytest.mark.parametrize(("first", "hour", "minutes"), [(date(2024, 3, 9), 2, 120), (date(2024, 11, 2), 1, 240)])
def test_hour_exposure(spark, first, hour, minutes):
    a, b = (calendar.day_start(date.fromordinal(first.toordinal() + k), "America/New_York") for k in (0, 3))
    got = {r.hour: r.elapsed_minutes for r in calendar.exposure(spark, a, b, "America/New_York", "hour").collect()}
    assert got[hour] == minutes


def test_range_kinds():
    today = date(2024, 3, 13)
    assert calendar.resolve("recent", today, days=7) == (date(2024, 3, 7), date(2024, 3, 14))
    assert calendar.resolve("month", today, start=date(2024, 2, 9)) == (date(2024, 2, 1), date(2024, 3, 1))
    with pytest.raises(ValueError):
        calendar.resolve("recent", today, days=401)
    with pytest.raises(ValueError):
        calendar.resolve("custom", today, start=today, end=today)


def test_sums_agree(spark):
    events = testdata.usage_event(spark, SF)
    stored = rollup.time_rollup(events).cache()
    whole = analytics.overview(stored, registry.START, registry.END).first()
    for kind in ("model", "project", "provider", "profile"):
        rows = analytics.breakdown(stored, registry.START, registry.END, kind).collect()
        assert all(sum(r[m] for r in rows) == whole[m] for m in METRICS)
    days = analytics.daily_series(stored, registry._targets()).collect()
    assert all(sum(r[m] for r in days) == whole[m] for m in METRICS)


def test_page_walk_is_whole(spark):
    events = testdata.usage_event(spark, SF, True).limit(300).cache()
    seen, at = [], None
    while rows := analytics.activity_page(events, 64, at).collect():
        seen += [r.fingerprint for r in rows]
        at = (rows[-1].timestamp_seconds, rows[-1].timestamp_nanos, rows[-1].fingerprint)
    assert len(seen) == len(set(seen)) == events.count()


def test_rates_round_once(spark):
    row = lambda n, **k: {"target": 1, "model": "gpt-5-nano", "tier": "standard_reported", "context": "short", "reported_state": "missing", "event_count": 1, "calculable_events": 1, "reported_events": 0, "uncached": n, "cached": 0, "billable": 0, "reported_cost": None} | k
    schema = "target long, model string, tier string, context string, reported_state string, event_count long, calculable_events long, reported_events long, uncached long, cached long, billable long, reported_cost long"
    rows = spark.createDataFrame([tuple(row(7, tier=t).values()) for t in ("standard_reported", "standard_assumed")], schema)
    got = pricing.select_cost(rows, pricing.catalogue(spark), "target").first()
    assert (got.amount, got.availability, got.assumed_events) == (1, "complete", 1)  # 0.35 twice is 0.7
    patched = pricing.catalogue(spark, [("gpt-5-nano", None, "standard", "short", 1_000_000, None, None)])
    assert pricing.select_cost(rows, patched, "target").first().amount == 14
    with pytest.raises(ValueError):
        pricing.catalogue(spark, [("a", None, "standard", "short", 1, 1, 1)] * 2)


def test_lineage_of_deep_and_round_chains(spark):
    chain = [(f"n{k}", f"n{k + 1}" if k < 40 else None) for k in range(41)]
    rows = spark.createDataFrame([("a", "b", *r, False) for r in (*chain, ("x", "y"), ("y", "z"), ("z", "x"))], "provider_id string, profile_id string, session_id string, parent_session_id string, relation_conflict boolean")
    got = {r.session_id: r for r in lineage.ancestors(rows).collect()}
    assert got["n0"].over and not got["n9"].over and got["n39"].depth == 1 and got["x"].cycle and got["y"].cycle and not got["n5"].cycle


def test_path_categories(spark):
    paths = {"a/vendor/x.rs": "vendor_generated", "Cargo.LOCK": "vendor_generated", "db\\migrations\\1.sql": "schema_migration", "a_test.go": "test", "README": "docs_spec", ".github/x.txt": "config_build", "a.PNG": "asset", "x.min.js": "vendor_generated", "m.rs": "product_code", "notes": "other", "/etc/x": None, "a/../b": None, "C:x": None, "": None}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", git_output.category(F.col("path")).alias("c"))
    assert {r.path: r.c for r in rows.collect()} == paths


def test_due_reminders_once(spark):
    lots = spark.createDataFrame([("s", 1, "available", 1_000_000_000)], "scope_id string, lot_id long, state string, expires_at_ms long")
    plan = benefit.schedule(lots)
    now = 1_000_000_000 - 40_000_000
    assert [r.lead_seconds for r in benefit.due(plan, now).collect()] == [43_200]
    done = spark.createDataFrame([(1, "in_app", 43_200)], "lot_id long, channel string, lead_seconds long")
    assert benefit.due(plan, now, done).count() == 0


def test_json_lines(spark, tmp_path):
    lines = [
        {"type": "session_meta", "payload": {"id": "S", "cwd": "/home/me/proj", "originator": "cli", "forked_from_id": "P", "git": {"branch": "main"}}},
        {"type": "turn_context", "payload": {"model": "gpt-5"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "Read_File"}},
        {"type": "event_msg", "timestamp": "2024-01-01T00:00:01.5Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 10, "cached_input_tokens": 99, "output_tokens": 5, "reasoning_output_tokens": 1}}}},
        {"type": "event_msg", "timestamp": 1704067205, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": "25", "cached_input_tokens": 99, "output_tokens": 5, "reasoning_output_tokens": 1}}}},
        {"timestamp": "2024-01-01T00:00:09Z", "model": "gpt-5.5", "usage": {"input_tokens": None, "prompt_tokens": "7", "total_tokens": 9}},
        {"timestamp": "2024-01-01T00:00:10Z", "usage": {"input_tokens": 0}},
    ]
    for place in ("sessions/a", "archived_sessions/a"):
        (tmp_path / place).mkdir(parents=True)
    (tmp_path / "sessions/a/log.jsonl").write_text("".join(json.dumps(x) + "\r\n" for x in lines) + "no json {\n")
    (tmp_path / "archived_sessions/a/log.jsonl").write_text(json.dumps(lines[-2]) + "\n")
    (tmp_path / "archived_sessions/a/old.jsonl").write_text(json.dumps(lines[-2]) + "\n")
    got = jsonl.observations(jsonl.discover(spark, str(tmp_path))).orderBy("relative", "ordinal").collect()
    assert [r.relative for r in got] == ["a/log.jsonl"] * 3 + ["a/old.jsonl"]
    a, b, c, old = got
    assert (a.input_tokens, a.cached_tokens, a.total_tokens, a.activity_read, a.timestamp_nanos, a.session_id, a.parent_session_id, a.project_alias, a.model) == (10, 10, 16, 1, 500_000_000, "S", "P", "proj", "gpt-5")
    assert (b.input_tokens, b.output_tokens, b.activity_read, b.timestamp_seconds) == (15, 0, 0, 1_704_067_205)
    assert (c.input_tokens, c.total_tokens, c.model, c.ordinal) == (7, 9, "gpt-5.5", 2) and old.session_id == "old"


def test_streamed_rollup_is_the_batch_rollup(spark, tmp_path):
    from tallymill.streaming.rollups import RollupStore, maintain

    events = testdata.usage_event(spark, SF)
    (tmp_path / "in").mkdir()
    for k in range(3):
        events.filter(F.col("source_offset") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = RollupStore(spark, str(tmp_path / "store"), every=2)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    maintain(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.active() == 2 and store.generations.parts() == ["base-1", "delta-2"]
    store.apply(events, 2)  # a batch that is given again changes nothing
    want = rollup.time_rollup(events)
    assert store.read().select(want.columns).exceptAll(want).isEmpty() and store.read().count() == want.count()
    store.compact()
    assert store.read().select(want.columns).exceptAll(want).isEmpty() and store.active() == 2


def test_stored_rollup_is_of_its_files(spark, tmp_path):
    from tallymill.sources import stored

    events = testdata.usage_event(spark, SF)
    (tmp_path / "e.parquet").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "e.parquet"))
    first = stored.stored_rollup(spark, events, str(tmp_path / "e.parquet"))
    again = stored.stored_rollup(spark, events.limit(0), str(tmp_path / "e.parquet"))
    assert again.count() == first.count() > 0  # the store is read, not built
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "e.parquet"))
    assert stored.stored_rollup(spark, events.limit(0), str(tmp_path / "e.parquet")).count() == 0
    text = first.filter("dimension = 'all' AND bucket_width = 3600")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in text


def _fold(rows, complete):
    """The state table, row by row: (child strong, signature, declared) against (parent strong, signature, declared) or None."""
    state, out = "matching", []
    for (strong, signature, bad), parent in rows:
        if state == "conflict" or bad or (parent and parent[2]):
            state, said = "conflict", "conflict"
        elif state == "diverged":
            said = "eligible"
        elif state == "pending":
            said = "pending"
        elif parent is None:
            state, said = ("diverged", "eligible") if complete else ("pending", "pending")
        elif not (strong and parent[0]):
            said = "pending"
        elif signature == parent[1]:
            said = "replay"
        else:
            state, said = "diverged", "eligible"
        out.append(said)
    return out


@pytest.mark.parametrize("complete", [True, False])
def test_replay_is_the_state_table(spark, complete):
    import random

    rng, rows, want = random.Random(7), [], {}
    for k in range(120):
        parent = {o: (rng.random() < 0.9, rng.choice("ab"), rng.random() < 0.04) for o in range(8) if rng.random() < 0.85}
        child = [(o, (rng.random() < 0.9, parent[o][1] if o in parent and rng.random() < 0.8 else "c", rng.random() < 0.03)) for o in range(8)]
        rows += [(f"p{k}", None, o, *v) for o, v in parent.items()] + [(f"c{k}", f"p{k}", o, *v) for o, v in child]
        want |= {(f"c{k}", o): d for (o, _), d in zip(child, _fold([(v, parent.get(o)) for o, v in child], complete))} if parent else {}
    table = spark.createDataFrame([("a", "b", s, p, o, g, a, "f", 0, o, f"{s}{o}", d, False) for s, p, o, a, g, d in rows], "provider_id string, profile_id string, session_id string, parent_session_id string, ordinal long, signature string, strong boolean, file_key string, generation int, source_offset long, fingerprint string, declared_conflict boolean, relation_conflict boolean")
    got = {(r.session_id, r.ordinal): r.disposition for r in lineage.classify(table, complete).filter("session_id LIKE 'c%'").collect()}
    assert all(got[k] == v for k, v in want.items()) and {"conflict", "replay", "eligible", "pending"} <= set(got.values())


def test_lines_that_matter(spark):
    keep = ["token_count", "turn_context", "session_meta", "sessionMeta", '"usage"', "function_call", "tool_call", "exec_command", "mcp", "back\\slash"]
    rows = spark.createDataFrame([(f"x{k}y",) for k in keep] + [("usage",), ("data",), ("result",), ("response",)], "value string")
    assert [r.value for r in rows.filter(jsonl.relevant(F.col("value"))).collect()] == [f"x{k}y" for k in keep]


def test_whole_lines_only(spark, tmp_path):
    for place in ("sessions", "archived_sessions"):
        (tmp_path / place).mkdir()
    (tmp_path / "sessions/a.jsonl").write_bytes(b"one\r\r\n\ntw\xc3\xb6\nopen")
    (tmp_path / "archived_sessions/a.jsonl").write_bytes(b"shadowed\n")
    (tmp_path / "archived_sessions/b.jsonl").write_bytes(b"old\n")
    got = sorted((r.relative, r.source_offset, r.value) for r in jsonl.discover(spark, str(tmp_path)).collect())
    (tmp_path / "sessions/c.jsonl").write_bytes(b"")
    (tmp_path / "archived_sessions/c.jsonl").write_bytes(b"shadowed by an empty one\n")
    assert got == [("a.jsonl", 0, "one\r"), ("a.jsonl", 6, ""), ("a.jsonl", 7, "two".replace("o", "ö")), ("b.jsonl", 0, "old")]
    assert jsonl.discover(spark, str(tmp_path), ["b.jsonl"]).count() == 1


@pytest.mark.parametrize(("text", "want"), [("2024-01-01T00:00:00.25Z", (1_704_067_200, 250_000_000)), ("2024-01-01T01:00:00+01:00", (1_704_067_200, 0)), ("1704067200", (1_704_067_200, 0)), ("1704067200123", (1_704_067_200, 123_000_000)), ("soon", None), ("2024-13-01T00:00:00Z", None)])
def test_moments(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(jsonl.moment(F.col("t")).alias("m")).first().m
    assert (tuple(got) if got else None) == want


def test_parents_and_tools(spark):
    lines = [
        {"type": "turn_context", "parent_thread_id": "A", "payload": {"source": {"subagent": {"thread_spawn": {"parent_thread_id": "A"}}}}},
        {"type": "x", "payload": {"type": "local_mcp_CALL", "name": " Open_Browser "}},
        {"type": "response_item", "payload": {"type": "message", "name": "grep", "text": "a\nb"}},
        {"type": "event_msg", "timestamp": 5, "payload": {"type": "token_count", "session_id": "S", "info": {"last_token_usage": {"input_tokens": 3}}}},
        {"type": "turn_context", "forked_from_id": "B", "payload": {}},
        {"timestamp": 6, "usage": {"input_tokens": 4}, "result": {"status": "no usage here"}},
        {"timestamp": "never", "usage": {"input_tokens": 4}},
    ]
    rows = [("f", "f.jsonl", "sessions", k * 10, json.dumps(x)) for k, x in enumerate(lines)]
    got = jsonl.observations(spark.createDataFrame(rows, "file string, relative string, place string, source_offset long, value string")).orderBy("ordinal").collect()
    assert [(r.parent_session_id, r.lineage_conflict, r.session_id, r.input_tokens) for r in got] == [("A", False, "S", 3), ("A", True, "S", 4)]
    assert (got[0].activity_web, got[0].activity_search, got[1].activity_web, got[0].fallback_model) == (1, 1, 0, 1)


def test_costs_follow_local_days(spark):
    first = date(2024, 3, 9)
    starts = [calendar.day_start(date.fromordinal(first.toordinal() + k), "America/New_York") for k in range(4)]
    rows = spark.createDataFrame([(s + d, k + (0 if d >= 0 else -1)) for k, s in enumerate(starts) for d in (-1, 0, 1)], "s long, want long")
    assert rows.filter(calendar.local_day(F.col("s"), first, "America/New_York") != F.col("want")).count() == 0
    assert (starts[2] - starts[1]) == 23 * 3600


def test_override_snapshots_are_all_or_none():
    ok = {("standard", "short"): (1, 2, 3)}
    rows, revision = pricing.snapshot({"m": ok}, {"nick": "m", "five": "gpt-5"})
    assert ("nick", "m", "standard", "short", 1, 2, 3) in rows and any(r[0] == "five" and r[1] == "gpt-5" for r in rows)
    assert revision != pricing.snapshot({"m": ok}, {"nick": "m"})[1] == pricing.snapshot({"m": dict(ok)}, {"nick": "m"})[1]
    for models, aliases in (({"gpt-5.6": ok}, {}), ({}, {"gpt-5": "gpt-5.1"}), ({"m": ok}, {"a": "b", "b": "m"}), ({}, {"a": "nothing"}), ({"m": {("standard", "short"): (1, None, 3)}}, {}), ({"m": {}}, {}), ({"m!": ok}, {}), ({}, {"a": "gpt-5.6"})):
        with pytest.raises(ValueError):
            pricing.snapshot(models, aliases)


def test_cursors_belong_to_a_dataset():
    at = analytics.cursor("g7", 5, 0, "f")
    assert analytics.resume(at, "g7") == (5, 0, "f") and analytics.resume(None, "g7") is None
    with pytest.raises(ValueError):
        analytics.resume(at, "g8")
    with pytest.raises(ValueError):
        git_output.day_range(0, 86_401)
    assert git_output.day_range(-86_400, 86_400) == (-1, 1)


_OID = "a" * 40


def _git(*tokens):
    return ("".join(t + "\0" for t in tokens)).encode()


@pytest.mark.parametrize(
    ("log", "want"),
    [
        (_git("\x1e" + _OID, "0", "a", "b", "", ":100644 100644 a b M", "7\t9\tfoo.rs", "1\t2\t7\t9\tfoo.rs"), [("7\t9\tfoo.rs", "text", 1, 2)]),
        (_git("\x1e" + _OID, "0", "a", "b", "", ":100644 100644 a b M", "\x1e:x", "1\t2\t\x1e:x"), [("\x1e:x", "text", 1, 2)]),
        (_git("\x1e" + _OID, "0", "a", "b", "", ":100644 160000 a b R100", "old", "new", "-\t-\t", "old", "new"), [("new", "submodule", None, None)]),
        (_git("\x1e" + _OID, "-1", "a", "b", _OID, "", "\x1e" + _OID, "0", "a", "b", ""), [(None, None, None, None)] * 2),
        (b"", []),
        (_git("\x1e" + _OID, "0", "a", "b", "", ":100644 100644 a b M", "x"), "mismatch"),
        (_git("\x1e" + _OID, "0", "a", "b", "", "1\t2\tx"), "mismatch"),
        (_git("\x1e" + _OID, "0", "a", "b", "", ":100644 100644 a b M", "x", "1\t2\ty"), "mismatch"),
        (_git("\x1e" + _OID, "0", "a", "b", "", ":100644 100644 a b M", "../x", "1\t2\t../x"), "path"),
        (_git("\x1e" + _OID, "0", "a", "b", "", ":100644 100644 a b M", "x", "1\t-\tx"), "protocol"),
        (_git("\x1e" + _OID, "0", "a", "b", "", "", "\n\x1e" + _OID, "0", "a", "b", ""), "protocol"),
        (_git("\x1e" + _OID, "0", "a", "b", "p q"), "object"),
        (_git("\x1e" + _OID, "soon", "a", "b", ""), "timestamp"),
        (_git("\x1e" + _OID, "0", "a" * 5000, "b", ""), "capacity"),
        (_git("\x1e" + _OID, "0", "a"), "incomplete"),
        (_git("x"), "protocol"),
    ],
)
def test_log_tokens_mean_what_their_place_says(log, want):
    from tallymill.sources import git_log

    rows = git_log._rows(log, {b"a"})
    assert [r[-1] for r in rows] == [want] if isinstance(want, str) else [r[4:8] for r in rows] == want and all(r[3] for r in rows)


def test_a_failed_text_withholds_its_repository(spark):
    logs = spark.createDataFrame([(1, _git("\x1e" + _OID, "0", "a", "b", "")), (1, b"junk\0"), (2, _git("\x1e" + _OID, "0", "a", "b", "")), (3, None)], "repository_id long, log binary")
    got = git_output.parse_log(logs, [])
    assert sorted((r.repository_id, r.error) for r in got.collect() if r.error) == [(1, "protocol")]
    assert [(r.repository_id, r.commit, r.selected) for r in git_output.sound(got).collect()] == [(2, _OID, False)]


def test_tokens_that_repeat_are_judged_once():
    import pyarrow as pa

    from tallymill.sources import git_log

    entry, path, n = ":100644 100644 aa bb M", "src/a.rs", 50
    log = _git("\x1e" + _OID, "0", "a", "b", "", *[entry, path] * n, *[f"3\t1\t{path}"] * n)
    git_log._entry.cache_clear()
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in git_log.SCHEMA.split(", ")]
    columns = git_log._columns(log, {b"a"}, kinds)
    assert git_log._entry.cache_info().misses == 1
    assert list(zip(*[c.to_pylist() for c in columns])) == git_log._rows(log, {b"a"}) == [(_OID, 0, 0, True, path, "text", 3, 1, None)] * n
