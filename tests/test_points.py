"""Point operators on hand-made clouds, and numbering over many partitions."""

import pytest
from pyspark.sql import functions as F

from cloudframe.operators import points
from cloudframe.plans import lineage


def cloud(spark, rows, columns="pid long, x double, y double, z double"):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_dense_over_many_partitions(spark, adaptive):
    n = 2_000_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(n).select((F.xxhash64("id")).alias("key"), "id", F.sha2(F.col("id").cast("string"), 256).alias("wide"))
        got = points.dense_ids(rows, ["key"])
        found = got.agg(F.count("*"), F.count_distinct("pid"), F.min("pid"), F.max("pid"), F.count_distinct("id"), F.count_distinct("wide")).first()
        assert tuple(found) == (n, n, 0, n - 1, n, n)
        wrong = got.select("pid", "key").join(got.select((F.col("pid") - 1).alias("pid"), F.col("key").alias("next")), "pid").where("key > next")
        assert wrong.isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_voxels_keep_every_cell(spark):
    n = 300_000
    unit = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(100_000)) / 1000).alias("xyz"[s])
    many = spark.range(n).select(F.col("id").alias("pid"), *[unit(s) for s in range(3)])
    cells = points.voxel_cells(many.drop("pid"), (1.0, 1.0, 1.0)).count()
    got = points.voxel_downsample(many, 1.0).agg(F.count("*"), F.count_distinct("pid"), F.max("pid")).first()
    assert tuple(got) == (cells, cells, cells - 1)


def test_voxel_order_and_means(spark):
    signed = cloud(spark, [(k, v, 0.0, 0.0) for k, v in enumerate((1.2, -0.8, 0.2, -1.2, 1.8))])
    assert [(r.pid, round(r.x, 6)) for r in points.voxel_downsample(signed, 1.0).orderBy("pid").collect()] == [(0, -1.2), (1, -0.8), (2, 0.2), (3, 1.5)]
    cube = cloud(spark, [(i * 4 + j * 2 + k, float(i), float(j), float(k)) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    assert [tuple(r) for r in points.voxel_downsample(cube, 2.0).select("x", "y", "z").collect()] == [(0.5, 0.5, 0.5)]
    colored = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 10, 300, 1.0), (1, 0.1, 0.0, 0.0, 11, 301, 2.0)], "pid long, x double, y double, z double, red smallint, intensity int, s double")
    row = points.voxel_downsample(colored, 1.0).first()
    assert (row.red, row.intensity, row.s) == (11, 301, 1.5)  # halves are rounded away from zero


@pytest.mark.parametrize("value", [float("nan"), float("inf"), 1e300])
def test_voxels_refuse_what_has_no_key(spark, value):
    with pytest.raises(Exception, match="not finite|out of range"):
        points.voxel_downsample(cloud(spark, [(0, value, 0.0, 0.0)]), 1.0).collect()


def test_empty_cloud(spark):
    empty = cloud(spark, [])
    assert points.voxel_downsample(empty, 1.0).count() == points.uniform_downsample(empty).count() == 0
    assert points.bounds(empty).first().n == 0


def test_rows_and_columns(spark):
    some = cloud(spark, [(k, float(k), 0.0, 0.0) for k in range(5)])
    assert points.row(some, 3).first().x == 3.0
    with pytest.raises(IndexError):
        points.row(some, 9)
    field = spark.createDataFrame([(k, k * 0.5) for k in range(5)], "pid long, heat double")
    with_field = points.with_attributes(some, field)
    assert points.scalar_fields(with_field) == ["heat"] and with_field.where(points.scalar(with_field, "heat") > 1.4).count() == 2
    with pytest.raises(KeyError):
        points.scalar(with_field, "cold")
    with pytest.raises(Exception, match="no attribute row"):
        points.with_attributes(some, field.where("pid < 3")).collect()
    with pytest.raises(ValueError, match="come together"):
        points.with_attributes(some, field.withColumnRenamed("heat", "nx"))
    with pytest.raises(ValueError, match="white space"):
        points.with_attributes(some, field.withColumnRenamed("heat", "a b"))


def test_masks_gather_and_structure(spark):
    some = cloud(spark, [(k, float(k), 0.0, 0.0) for k in range(6)])
    masked = some.withColumn("keep", F.col("pid") % 2 == 0)
    ids = lambda df: sorted(r.pid for r in df.collect())
    assert ids(points.kept_ids(masked)) == [0, 2, 4] and ids(points.removed_ids(masked)) == [1, 3, 5]
    assert ids(points.complement(some, points.kept_ids(masked))) == [1, 3, 5]
    picks = spark.createDataFrame([(0, 4), (1, 4), (2, 0)], "position long, pid long")
    assert [r.x for r in points.gather(some, picks).orderBy("position").collect()] == [4.0, 4.0, 0.0]
    with pytest.raises(Exception, match="out of range"):
        points.gather(some, spark.createDataFrame([(0, 77)], "position long, pid long")).collect()
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 9, -1)], "fid long, a int, b int, c int")
    assert sorted(tuple(r) for r in points.validate_faces(some, faces).collect()) == [(1, 1, 9), (1, 2, -1)]


def test_uniform_keeps_what_is_not_finite(spark):
    some = cloud(spark, [(0, float("nan"), 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, float("inf"), 0.0, 0.0)])
    assert sorted(r.pid for r in points.uniform_downsample(some, 2).collect()) == [0, 2]
    assert points.uniform_downsample(some, -4).count() == 3


def test_what_was_written_is_removed_on_request(spark):
    lineage.cut(spark.range(3).toDF("id"))
    from pathlib import Path

    folder = Path(lineage.shared_dir(spark)) / f"cloudframe-{lineage._RUN}"
    assert any(folder.iterdir())
    lineage.release(spark)
    assert not folder.exists()
