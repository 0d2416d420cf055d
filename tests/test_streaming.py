"""Streams give what batches give."""

from __future__ import annotations

from pyspark.sql import functions as F
from terraloom.streaming import windows

from .conftest import rows


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_tumbling_windows(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    got = run(windows.tumbling(stream, "ts", "event_type", "value", "6 hours"), "tumbling", "complete")
    want = windows.tumbling(batch, "ts", "event_type", "value", "6 hours")
    cut = lambda d: rows(d.select("event_type", "start", "n", F.round("total", 4)))
    assert cut(got) == cut(want)


def test_running_moments(spark, tmp_path):
    p = spark.range(60).select((F.col("id") % 4).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("id") / 8).alias("z"))
    p.repartition(3).write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p")
    got = run(windows.running_moments(stream, 2.0), "moments", "update")
    last = rows(got.groupBy("i", "j", "k").agg(F.max("n").alias("n"), F.max("sz").alias("sz"), F.max("szz").alias("szz")))
    from terraloom.operators import voxels

    assert last == rows(voxels.moments(p, 2.0).select("i", "j", "k", "n", "sz", "szz"))


def test_deduplicated(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:00")], "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert windows.deduplicated(df, "ts", ["k"], "1 hour").count() == 2
