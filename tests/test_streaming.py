"""Voxel aggregates over a stream against the same aggregates over the whole."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cloudframe.streaming.voxels import stream_voxels

SCHEMA = "pid long, x double, y double, z double"


def test_voxels_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3)) for k in range(400)]
    rows += [(400, float("nan"), 0.0, 0.0), (401, 0.0, float("inf"), 0.0)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "points"))
    points = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "points"))
    query = (
        stream_voxels(points, 2.0).writeStream.outputMode("complete").format("memory").queryName("streamed_voxels")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    want = {}
    for _, *p in rows[:400]:
        want.setdefault(tuple(math.floor(c / 2.0) for c in p), []).append(p)
    got = {tuple(r[:3]): r for r in spark.table("streamed_voxels").select("kx", "ky", "kz", "n", "x", "y", "z").collect()}
    assert got.keys() == want.keys()
    for key, inside in want.items():
        assert got[key].n == len(inside)
        assert list(got[key][4:]) == pytest.approx([sum(c) / len(inside) for c in zip(*inside, strict=True)])


def test_time_windows(spark):
    rows = [(0.1, 0.1, 0.1, "2024-01-01 00:10:00"), (0.3, 0.1, 0.1, "2024-01-01 00:50:00"), (0.2, 0.1, 0.1, "2024-01-01 01:10:00")]
    points = spark.createDataFrame(rows, "x double, y double, z double, t string").withColumn("t", F.to_timestamp("t"))
    got = stream_voxels(points, 1.0, time="t").orderBy("window").collect()
    assert [r.n for r in got] == [2, 1]
    assert [r.x for r in got] == pytest.approx([0.2, 0.2])
