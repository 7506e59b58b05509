"""Quota windows kept in generations, and followed in stretches, against the state machine and whole windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymill.operators import quota
from tallymill.sources import testdata
from tallymill.streaming.quota import WindowStore

SF = "/root/testdata/sf0.001"


def test_store_of_windows_equals_the_batch(spark, tmp_path):
    # every window is met in each batch but one, and half of the moments are shared by windows
    samples = testdata.quota_samples(spark, SF).filter("window_id <> 'error' OR observation_id > 60").cache()
    third = F.ntile(3).over(Window.orderBy("observed_at_ms"))
    parts = [samples.withColumn("t", third).filter(F.col("t") == k).drop("t") for k in (1, 2, 3)]
    store = WindowStore(spark, str(tmp_path))
    for k, rows in enumerate([parts[0], parts[1].unionByName(parts[0]), parts[2]]):
        store.apply(rows, k)
        store.apply(rows, k)
    want = quota.transitions(samples)
    got = store.told().cache()
    shared = [c for c in got.columns if c in want.columns]
    assert {"signal", "epoch_id", "previous_epoch_id", "transition_id", "sequence"} <= set(shared)
    assert sorted(map(repr, got.select(shared).collect())) == sorted(map(repr, want.select(shared).collect()))
    best = quota.maxima(want)
    assert sorted(map(repr, got.select(best.columns).collect())) == sorted(map(repr, best.collect()))
