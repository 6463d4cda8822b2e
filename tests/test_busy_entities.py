import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import timeseries


def features(df, block, window=3):
    got, names = timeseries.timeseries_features(df, "ts", "who", ["a", "b"], "k", window, 60.0, block)
    return names, {r.k: [r[n] for n in names] + [r._spikes, r._missing] for r in got.collect()}, got


def test_busy_entities_in_blocks(spark):
    """One entity has most rows, with equal times and gaps; one has no name. Blocks give what whole entities give."""
    rnd = np.random.default_rng(6)
    rows = []
    for k in range(1200):
        who = "hot" if k % 3 else [None, "cold", "mild"][k // 3 % 3]
        second = int(rnd.integers(0, 400)) + (5000 if k % 7 == 0 else 0)
        rows.append((k, who, f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}", float(rnd.normal()) if k % 11 else None, float(k % 5), "x"))
    df = spark.createDataFrame(rows, "k long, who string, t string, a double, b double, _block string").withColumn("ts", F.to_timestamp("t")).drop("_block")
    names, want, _ = features(df, 10_000)
    for block, window in ((100, 3), (37, 3), (150, 6)):
        if window != 3:
            want = features(df, 10_000, window)[1]
        got = features(df, block, window)[1]
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert np.allclose(got[k], v, atol=1e-9), (k, names)


def test_no_group_holds_a_busy_entity(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("who"), F.timestamp_seconds("id").alias("ts"), F.rand(1).alias("a"))
    most = timeseries.of_entities(df, "ts", "who", "k", 2, 200).groupBy("who", "_block").count().agg(F.max("count")).first()[0]
    assert most <= 500
