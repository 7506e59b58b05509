"""Observations kept in generations, a batch followed stretch by stretch, against the batch parser."""

import json
import os
import random

from pyspark.sql import functions as F

from tallymill.plans import batches, ingest
from tallymill.sources import jsonl
from tallymill.streaming.parsing import ObservationStore

SF = "/root/testdata/sf0.001"


def _lines(spark, n):
    dice, out, at = random.Random(11), [], {}
    for _ in range(n):
        f, k = dice.choice(["a.jsonl", "b.jsonl", "c.jsonl"]), dice.randrange(60)
        usage = lambda: {"input_tokens": dice.choice([0, 5, 9]), "output_tokens": dice.choice([None, 2, 3]), "total_tokens": dice.choice([0, 20])}  # noqa: B023, E731
        line = dice.choice([
            {"type": "session_meta", "payload": {"id": f"s{k % 3}", "cwd": f"/h/p{k % 2}", "forked_from_id": dice.choice([None, f"s{k % 5}"]), "model": dice.choice([None, f"m{k % 2}"])}},
            {"type": "event_msg", "timestamp": dice.choice(["never", 1_700_000_000 + k]), "payload": {"type": "token_count", "model": dice.choice([None, f"n{k % 4}"]), "info": {"total_token_usage": usage()}}},
            {"type": "event_msg", "timestamp": 1_700_000_000 + k, "payload": {"type": "token_count", "info": {"last_token_usage": usage(), "total_token_usage": dice.choice([None, usage()])}}},
            {"created_at": "2024-01-01T00:00:00.5Z", "data": {"usage": usage()}, "result": {"usage": usage(), "model": "r"}},
            {"type": "response_item", "payload": {"type": "function_call", "name": dice.choice(["grep", "cat", "sh"])}},
        ])
        text = json.dumps(line)
        out.append((f, f, at.get(f, 0), text))
        at[f] = at.get(f, 0) + len(text) + 1
    return spark.createDataFrame(out, "file string, relative string, source_offset long, value string").cache()


def test_store_of_observations_equals_the_batch(spark, tmp_path, monkeypatch):
    lines = _lines(spark, 240)
    monkeypatch.setattr(jsonl, "STRETCH_BYTES", 700)
    end = lines.agg(F.max("source_offset")).first()[0]
    first = lambda a, z: lines.filter(F.col("source_offset").between(int(end * a) + 1, int(end * z)) | ((F.col("source_offset") == 0) & F.lit(a == 0)))
    now = lambda rows, generation: rows.withColumn("generation", F.lit(generation))
    # c says nothing in the second batch, and a is written anew in the third
    again = lines.filter("file = 'b.jsonl'").withColumns({"file": F.lit("a.jsonl"), "relative": F.lit("a.jsonl")})
    given = [now(first(0, 0.3), 0), now(first(0.3, 0.55), 0).filter("file <> 'c.jsonl'"), now(first(0.55, 1), 0).unionByName(now(again, 1)), now(lines.limit(0), 0)]
    store = ObservationStore(spark, str(tmp_path))
    for k, rows in enumerate(given):
        store.apply(rows, k)
        store.apply(rows.limit(1), k)
        assert sorted(os.listdir(tmp_path / f"delta-{k}")) == ["state", "told"]
    whole = given[0].unionByName(given[1]).unionByName(given[2])
    shown = lambda d, g: sorted(map(repr, d.filter(F.col("generation") == g).drop("generation").collect()))
    got = store.observations().cache()
    for g in (0, 1):
        want = jsonl.observations(whole.filter(F.col("generation") == g).drop("generation"))
        assert shown(got, g) == sorted(map(repr, want.collect())) and shown(got, g)


def test_registered_stream_follows_no_file_in_one_task(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a batch is one file, and a file of logs one task")

    monkeypatch.setattr(batches, "streamed", refused)
    monkeypatch.setattr(batches, "source", refused)
    got, want = (ingest.QUERIES[q](spark, SF) for q in ("r4_streamed_observations", "s6_observations"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
