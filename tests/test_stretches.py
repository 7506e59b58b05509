"""Running values stretch by stretch against plain windows and folds over whole keys."""

import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymill.functions.stretches import along
from tallymill.sources import jsonl


def test_along_is_a_window_over_the_whole_key(spark):
    dice = random.Random(3)
    rows = spark.createDataFrame([(dice.choice(["a", "b", None]), n, dice.choice([None, dice.randrange(50)])) for n in range(400)], "k string, n int, v long").withColumn("stretch", F.floor(F.col("n") / 7))
    kinds = ("last", "first", "max", "sum", "last_before", "sum_before", "total")
    got = along(rows, ("k",), "n", {k: (k, F.col("v")) for k in kinds})
    to, w = Window.partitionBy("k").orderBy("n"), F.col("v")
    so_far, before = to.rowsBetween(Window.unboundedPreceding, 0), to.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    want = rows.withColumns({
        "last": F.last(w, True).over(so_far), "first": F.first(w, True).over(so_far), "max": F.max(w).over(so_far), "sum": F.coalesce(F.sum(w).over(so_far), none),
        "last_before": F.last(w, True).over(before), "sum_before": F.coalesce(F.sum(w).over(before), none), "total": F.sum(w).over(Window.partitionBy("k")),
    })
    tell = lambda d: sorted((r.n, *[r[k] for k in kinds]) for r in d.collect())
    assert repr(tell(got)) == repr(tell(want))


def _lines(spark, n):
    dice, out, at = random.Random(5), [], {}
    for _ in range(n):
        f, k = dice.choice(["a.jsonl", "b.jsonl"]), dice.randrange(60)
        usage = {"input_tokens": dice.randrange(40), "output_tokens": dice.randrange(3)}
        line = dice.choice([
            {"type": "session_meta", "payload": {"id": f"s{k % 3}", "forked_from_id": f"s{k % 5}", "model": f"m{k % 2}"}},
            {"type": "event_msg", "timestamp": 1_700_000_000 + k, "payload": {"type": "token_count", "model": f"n{k % 4}", "info": {"total_token_usage": usage}}},
            {"type": "response_item", "payload": {"type": "function_call", "name": "grep"}},
        ])
        text = json.dumps(line)
        out.append((f, f, "sessions", at.get(f, 0), text))
        at[f] = at.get(f, 0) + len(text) + 1
    return spark.createDataFrame(out, "file string, relative string, place string, source_offset long, value string")


def test_files_in_stretches_say_what_whole_files_say(spark, monkeypatch):
    lines = _lines(spark, 90)
    tell = lambda: [sorted(map(repr, d.collect())) for d in (jsonl.observations(lines), jsonl.state_after(lines))]
    whole = tell()
    monkeypatch.setattr(jsonl, "STRETCH_BYTES", 300)
    assert tell() == whole and whole[0]
