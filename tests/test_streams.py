"""Streaming stores and state machines against their batch forms, for any split into batches."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import benefit, lineage, quota, rollup
from tallymill.plans import batches
from tallymill.plans.replay import late_batches
from tallymill.sources import jsonl, log_source, testdata
from tallymill.streaming import generations, parsing, reminders
from tallymill.streaming import lineage as replay
from tallymill.streaming import quota as windows
from tallymill.streaming.rollups import RollupStore
from tallymill.streaming.state import drained

SF = "/root/testdata/sf0.001"


# ---- late relations ----------------------------------------------------------------------------------------------------


def _classes(rows):
    return sorted((r.provider_id, r.profile_id, r.session_id, r.ordinal, r.source_offset, r.fingerprint, r.disposition) for r in rows.collect())


def test_late_relations_give_the_classes_of_a_full_run(spark, tmp_path, complete=True):
    rng, rows, told = random.Random(11), [], []
    for k in range(60):
        session, profile = f"s{k % 40}", f"p{k // 40}"
        parent = f"s{rng.randrange(40)}" if rng.random() < 0.7 else None
        late = rng.random() < 0.5
        told.append(("c", profile, session, parent, rng.random() < 0.03))
        for o in range(rng.randrange(1, 6)):
            rows.append((rng.randrange(3), "c", profile, session, None if late else parent, o, rng.choice("ab"), rng.random() < 0.9, "f", 0, o, f"{profile}{session}{o}{rng.randrange(2)}", rng.random() < 0.03, False))
    schema = "batch int, provider_id string, profile_id string, session_id string, parent_session_id string, ordinal long, signature string, strong boolean, file_key string, generation long, source_offset long, fingerprint string, declared_conflict boolean, relation_conflict boolean"
    seen = spark.createDataFrame(rows, schema).cache()
    relations = spark.createDataFrame(told, "provider_id string, profile_id string, session_id string, parent_session_id string, relation_conflict boolean")
    store = replay.ReplayStore(spark, str(tmp_path / "store"), complete, buckets=2, every=3)
    for n in range(3):
        store.apply(seen.filter(F.col("batch") == n).drop("batch"), n)
    assert _classes(store.current()) == _classes(lineage.classify(seen.drop("batch"), complete))
    store.apply(seen.limit(0).drop("batch"), 3, relations)
    store.apply(seen.drop("batch"), 3)  # a batch that is given again changes nothing
    everything = seen.drop("batch").unionByName(relations.withColumns({c: F.lit(None).cast(t) for c, t in seen.drop("batch").dtypes if c not in relations.columns}))
    want = [r for r in _classes(lineage.classify(everything.fillna({"ordinal": -1, "strong": False, "declared_conflict": False}), complete)) if r[3] >= 0]
    # the bare relations stand as rows of ordinal -1 in the full run
    assert _classes(store.current()) == want
    store.compact()
    assert len(_classes(store.current())) == len(rows)


def test_a_session_of_all_rows_is_many_tasks_work(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("c", "p", s, "a" if s == "b" else None, o, rng.choice("aab"), rng.random() < 0.95, "f", 0, o, f"{s}{o}{k}", rng.random() < 0.002, False) for s in "ab" for o in range(200) for k in range(rng.randrange(1, 3)) if s == "b" or rng.random() < 0.99]
    schema = "provider_id string, profile_id string, session_id string, parent_session_id string, ordinal long, signature string, strong boolean, file_key string, generation long, source_offset long, fingerprint string, declared_conflict boolean, relation_conflict boolean"
    same = [(*r[:5], "a", *r[6:11], False, False) if r[4] < 150 else r for r in rows]
    for some in (rows, same):
        seen = spark.createDataFrame(some, schema)
        monkeypatch.setattr(lineage, "HOT", 1 << 40)
        want = _classes(lineage.classify(seen))
        monkeypatch.setattr(lineage, "HOT", 100)
        monkeypatch.setattr(lineage, "BLOCK", 50)
        assert _classes(lineage.classify(seen)) == want
    assert len({r[-1] for r in want}) > 1


def test_untouched_trees_are_not_read_again(spark, tmp_path):
    seen = testdata.turn_observations(spark, SF).cache()
    store = replay.ReplayStore(spark, str(tmp_path / "store"), buckets=64)
    early, later, relations = late_batches(seen)
    store.apply(early.unionByName(later), 0)
    name = seen.filter("session_id LIKE 'f%'").first().session_id
    store.apply(later.limit(0), 1, relations.filter(F.col("session_id") == name))
    # its own bucket, its parent's and those of what descends from it, of 64
    assert 0 < len(store.read) <= 4
    some = store._open("seen", relations.filter(F.col("session_id") == name).select(*lineage.KEY).distinct())
    assert "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket")
    assert store.current().count() == seen.count()


def test_streamed_replay(spark, tmp_path):
    seen = testdata.turn_observations(spark, SF)
    stream = batches.source(spark, [seen.filter("ordinal >= 2"), seen.filter("ordinal < 2")])
    store = replay.ReplayStore(spark, str(tmp_path / "store"), buckets=2)
    replay.maintain(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.generations.active() == 1 and _classes(store.current()) == _classes(lineage.classify(seen))


def test_few_buckets_are_written_by_many_tasks(spark, tmp_path):
    """A bucket of the replay store has several files, each session in one of them, and its rows are those given."""
    store = replay.ReplayStore(spark, str(tmp_path / "store"), buckets=1)
    rows = [("codex", "profile_0", f"s{k}", None, t, "x", True, "file_s", 0, 100 * k + t, f"{k}-{t}", False, False) for k in range(300) for t in range(3)]
    given = spark.createDataFrame(rows, replay.SCHEMAS["seen"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.apply(given, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for kind in ("seen", "class"):
        written = spark.read.parquet(str(tmp_path / "store" / "delta-0" / kind)).withColumn("at", F.input_file_name())
        assert written.count() == 900 and written.select("at").distinct().count() > 1
        assert written.select("session_id", "at").distinct().count() == 300
    assert store.current().filter("disposition = 'eligible'").count() == 900


# ---- generations and rollups -------------------------------------------------------------------------------------------


def test_one_of_two_writers_fails(spark, tmp_path):
    a, b = (generations.Generations(spark, str(tmp_path / "g")) for _ in range(2))
    a.commit("delta-0")
    with pytest.raises(generations.Taken):
        b.commit("delta-0")
    assert b.active() == 0 and b.parts() == ["delta-0"]


def test_changes_across_batches_and_compactions(spark, tmp_path):
    events = testdata.usage_event(spark, SF).cache()
    rng, alive, log = random.Random(3), set(), []
    ids = [r.source_offset for r in events.select("source_offset").collect()]
    for n in range(6):
        came = set(rng.sample(ids, 200)) - alive
        went = set(rng.sample(sorted(alive), len(alive) // 3))
        log.append((came, went))
        alive = (alive | came) - went
    store = RollupStore(spark, str(tmp_path / "store"), every=2)
    of = lambda some, kind: events.filter(F.col("source_offset").isin(sorted(some))).withColumn("change", F.lit(kind))
    for n, (came, went) in enumerate(log):
        batch = of(came, "insert").unionByName(of(went, "delete"))
        store.apply_changes(batch, n)
        store.apply_changes(batch, n)
    want = rollup.time_rollup(events.filter(F.col("source_offset").isin(sorted(alive))))
    got = store.read().select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert sorted(p for p in os.listdir(tmp_path / "store") if not p.startswith("_")) == ["base-3", "base-5", "delta-4", "delta-5"]


def test_a_batch_of_changes_is_read_once(spark, tmp_path, monkeypatch):
    change = F.when(F.col("source_offset") % 2 == 0, "insert").otherwise("delete")
    changes = testdata.usage_event(spark, SF).withColumn("change", change)
    store, plans = RollupStore(spark, str(tmp_path / "store")), []
    monkeypatch.setattr(store, "_publish", lambda rows, n: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    store.apply_changes(changes, 0)
    assert plans[0].count("Relation [") == 1


# ---- log source and parser ---------------------------------------------------------------------------------------------


def _read(spark, root, **options):
    return sorted((r.relative, r.generation, r.source_offset, r.value) for r in log_source.lines(spark, str(root), **options).collect())


def test_ranges_give_the_same_lines(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    (tmp_path / "sessions/deep").mkdir(parents=True)
    texts = {f"deep/{k}.jsonl": b"".join(bytes(rng.choice(b"abc\r") for _ in range(rng.choice([0, 1, 7, 300]))) + b"\n" for _ in range(40)) + b"open" * (k % 2) for k in range(3)}
    for name, data in texts.items():
        (tmp_path / "sessions" / name).write_bytes(data)
    want = []
    for name, data in texts.items():
        at = 0
        for line in data.split(b"\n")[:-1]:
            want.append((name, 0, at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
    assert _read(spark, tmp_path) == sorted(want) == _read(spark, tmp_path, rangeBytes=50)
    assert _read(spark, tmp_path, only=["deep/1.jsonl", "gone.jsonl"]) == [w for w in sorted(want) if w[0] == "deep/1.jsonl"]
    monkeypatch.setattr(log_source, "LINE_BYTES", 100)
    monkeypatch.setattr(log_source, "BLOCK", 2)
    logs = log_source._Logs({"path": str(tmp_path)})
    for step in (1 << 20, 64):
        logs.range_bytes = step
        got = [(r["relative"], 0, r["source_offset"], r["value"]) for name, data in texts.items() for p in logs.ranges(name, "sessions", 0, 0, len(data)) for b in logs.read(p) for r in b.to_pylist()]
        assert sorted(got) == sorted(w for w in want if len(w[3]) < 100)


def test_lines_reach_the_filter_without_a_shuffle(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    plan = jsonl.facts(jsonl.discover(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_tail_reads_new_bytes_alone(spark, tmp_path, monkeypatch):
    place = tmp_path / "sessions"
    place.mkdir()
    read = []
    whole = log_source._Logs.bytes
    monkeypatch.setattr(log_source._Logs, "bytes", lambda self, p, r, a, z: (read.append(z - a), whole(self, p, r, a, z))[1])
    (place / "a.jsonl").write_bytes(b"x" * 5000 + b"\n" + b"half")
    (place / "b.jsonl").write_bytes(b"one\ntwo\n")
    options = {"path": str(tmp_path), "state": str(tmp_path / "state")}

    def step(reader, start):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        reader.commit(end)
        return end, [(p.relative, p.generation, p.start, p.end) for p in parts]

    reader = log_source._Stream(options)
    end, parts = step(reader, {})
    assert parts == [("a.jsonl", 0, 0, 5001), ("b.jsonl", 0, 0, 8)]
    read.clear()
    assert step(reader, end)[1] == [] and read == []  # nothing new, nothing read
    with open(place / "a.jsonl", "ab") as f:
        f.write(b" more\nand\n")
    end, parts = step(log_source._Stream(options), end)  # a restart goes on from what was committed
    assert parts == [("a.jsonl", 0, 5001, 5015)] and sum(read) <= 2 * log_source.ANCHOR + 14
    (place / "a.jsonl").write_bytes(b"y" * 5000 + b"\n" + b"half more\nand\nsome\n")  # rewritten, and longer
    (place / "b.jsonl").write_bytes(b"one\n")  # cut
    end, parts = step(log_source._Stream(options), end)
    assert parts == [("a.jsonl", 1, 0, 5020), ("b.jsonl", 1, 0, 4)]
    os.replace(place / "b.jsonl", place / "c.jsonl")
    assert step(log_source._Stream(options), end)[1] == [("c.jsonl", 0, 0, 4)]


def _lines(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        count = lambda: {"input_tokens": rng.randrange(50), "output_tokens": rng.randrange(9), "reasoning_output_tokens": rng.choice([0, 3, None])}
        kinds = (
            {"type": "session_meta", "payload": {"id": f"S{rng.randrange(3)}", "cwd": f"/h/p{rng.randrange(3)}", "forked_from_id": rng.choice([None, "S0", "Q"]), "model": rng.choice([None, "m1", "  "])}},
            {"type": "event_msg", "timestamp": 1_700_000_000 + k, "payload": {"type": "token_count", "model": rng.choice([None, "m2", "a b"]), "info": {"total_token_usage": count()}}},
            {"type": "event_msg", "timestamp": 1_700_000_000 + k, "payload": {"type": "token_count", "info": {"last_token_usage": count(), "total_token_usage": rng.choice([None, count()])}}},
            {"timestamp": "2024-01-01T00:00:00Z", "result": {"usage": count(), "model": rng.choice([None, "m3"])}},
            {"type": "response_item", "payload": {"type": "function_call", "name": rng.choice(["grep", "patch", "sh"])}},
            {"type": "turn_context", "payload": {"originator": rng.choice(["a", "b"]), "model_context_window": rng.choice([0, 99])}},
        )
        out.append(json.dumps(rng.choice(kinds)))
    return out


def test_parser_state_gives_the_batch_rows(spark, tmp_path):
    root, place = tmp_path / "logs", tmp_path / "logs/sessions"
    place.mkdir(parents=True)
    texts = {f"f{k}.jsonl": "".join(x + "\n" for x in _lines(80, k)).encode() for k in range(3)}
    run = lambda: drained(parsing.observations(log_source.tailed(spark, str(root), str(tmp_path / "state"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    for share in (0.3, 0.55, 1.0):
        for name, data in texts.items():
            (place / name).write_bytes(data[: int(len(data) * share)])
        got = run()
    want = jsonl.observations(jsonl.discover(spark, str(root)))
    rows = lambda d: sorted(repr(r) for r in d.select(want.columns).collect())
    assert rows(got) == rows(want) and want.count() > 50
    (place / "f0.jsonl").write_bytes(texts["f1.jsonl"][:-1] + b" \n" + texts["f0.jsonl"])  # another file of that name starts anew
    again = run().filter("generation = 1")
    assert rows(again) == rows(jsonl.observations(jsonl.discover(spark, str(root), ["f0.jsonl"])))


# ---- windows and reminders ---------------------------------------------------------------------------------------------


def test_streamed_windows_equal_the_batch(spark):
    samples = testdata.quota_samples(spark, SF).cache()
    cuts = samples.approxQuantile("observed_at_ms", [0.2, 0.4, 0.7], 0)
    parts = [samples.filter(F.col("observed_at_ms").between(a + 1, z)) for a, z in zip([-1, *cuts], [*cuts, 1 << 50])]
    # all that came before is given again, as stale and repeated samples are
    given = [parts[0], parts[1].unionByName(parts[0]), parts[2], parts[3].unionByName(parts[1]).unionByName(parts[2])]
    got = batches.streamed(spark, given, windows.transitions)
    want = quota.transitions(samples)
    shared = [c for c in got.columns if c in want.columns]
    assert {"signal", "epoch_id", "previous_epoch_id", "transition_id", "sequence"} <= set(shared)
    assert sorted(map(repr, got.select(shared).collect())) == sorted(map(repr, want.select(shared).collect()))
    best = quota.maxima(want)
    assert sorted(map(repr, got.select(best.columns).collect())) == sorted(map(repr, best.collect()))


def test_reminders_at_each_step_of_a_clock(spark):
    rng, base = random.Random(9), 1_700_000_000_000
    pending = [("s", lot, lot % 2, "in_app", lead, base + x - lead * 1000, base + x) for lot in range(25) for x in [rng.randrange(90_000)] for lead in rng.sample([1, 5, 20, 60], 3)]
    receipts = [("s", lot, lot % 2, "in_app", 5) for lot in range(0, 25, 5)]
    clock = [base + t for t in (1_000, 30_000, 30_001, 88_000, 200_000)]
    schema = reminders.SCHEMA
    tick = lambda at: (at, None, None, None, None, None, None, None)
    frames = []
    for k, at in enumerate(clock):
        mine = [p for p in pending if p[1] % 3 == k] if k < 3 else []
        given = [(*r, None, None) for r in receipts] if k == 0 else []
        rows = [(at, *r) for r in mine + given] + [tick(at)]
        frames.append(spark.createDataFrame(rows, schema.replace("at timestamp", "at long")).withColumn("at", F.timestamp_millis("at")))
    told = batches.streamed(spark, frames, reminders.processed).cache()
    waiting, done = [], list(receipts)
    names = "scope_id string, lot_id long, lot_revision long, channel string, lead_seconds long"
    for k, at in enumerate(clock):
        waiting += [p for p in pending if p[1] % 3 == k] if k < 3 else []
        rows = spark.createDataFrame(waiting, f"{names}, due_at_ms long, expires_at_ms long")
        sent, sums = benefit.process_due(rows, spark.createDataFrame(done, names), at)
        now = told.filter(F.col("now_ms") == at)
        want = sorted((r.lot_id, r.lot_revision, r.lead_seconds, r.due_at_ms, r.expires_at_ms) for r in sent.collect())
        assert sorted((r.lot_id, r.lot_revision, r.lead_seconds, r.due_at_ms, r.expires_at_ms) for r in now.filter("sent").collect()) == want
        columns = ["scope_id", "taken", "expired", "delivered", "suppressed"]
        assert [tuple(r) for r in reminders.counts(now).select(columns).collect()] == [tuple(r) for r in sums.select(columns).collect()]
        waiting = [p for p in waiting if p[5] > at]
        done += [("s", lot, rev, "in_app", lead) for lot, rev, lead, _, _ in want]
    assert not waiting and told.filter("now_ms > 0").count() == told.count()


def test_reminder_store_equals_the_state_machine_without_a_call_a_key(spark, tmp_path):
    """Registered streams of reminders run no Python for a key; receipts, expiries, late rows and repeated batches give the same."""
    rng, base = random.Random(4), 1_700_000_000_000
    pending = [("s", lot, 0, "in_app", lead, base + x - lead * 1000, base + x) for lot in range(40) for x in [rng.randrange(90_000)] for lead in rng.sample([1, 5, 20, 60], 3)]
    clock = [base + t for t in (1_000, 30_000, 88_000, 200_000)]
    frames, waiting, done = [], [], [("s", lot, 0, "in_app", 5) for lot in range(0, 40, 5)]
    store = reminders.ReminderStore(spark, str(tmp_path / "store"))
    names = "scope_id string, lot_id long, lot_revision long, channel string, lead_seconds long"
    for k, at in enumerate(clock):
        mine = [p for p in pending if p[1] % 2 == k]
        given = [(at, *r, None, None) for r in done] if k == 0 else []
        rows = [(at, *r) for r in mine] + given + [(at, *[None] * 7)]
        frames.append(spark.createDataFrame(rows, reminders.SCHEMA.replace("at timestamp", "at long")).withColumn("at", F.timestamp_millis("at")))
    batches.applied(spark, frames, store.apply)
    store.apply(frames[1], 1)
    told = store.told().cache()
    for k, at in enumerate(clock):
        waiting += [p for p in pending if p[1] % 2 == k]
        sent, sums = benefit.process_due(spark.createDataFrame(waiting, f"{names}, due_at_ms long, expires_at_ms long"), spark.createDataFrame(done, names), at)
        now = told.filter(F.col("now_ms") == at)
        want = sorted((r.lot_id, r.lead_seconds, r.due_at_ms, r.expires_at_ms) for r in sent.collect())
        assert sorted((r.lot_id, r.lead_seconds, r.due_at_ms, r.expires_at_ms) for r in now.filter("sent").collect()) == want
        columns = ["scope_id", "taken", "expired", "delivered", "suppressed"]
        assert [tuple(r) for r in reminders.counts(now).select(columns).collect()] == [tuple(r) for r in sums.select(columns).collect()]
        waiting = [p for p in waiting if p[5] > at]
        done += [("s", lot, 0, "in_app", lead) for lot, lead, _, _ in want]
    assert told.count() and "InPandas" not in told._jdf.queryExecution().toString()
