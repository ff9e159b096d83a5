"""A growing folder of PLY files as a stream, stopped and started again."""

import struct

import pytest

from cloudframe.operators.points import voxel_cells
from cloudframe.sources.ply import write_ply
from cloudframe.streaming.clouds import CloudsReader, stream_clouds
from cloudframe.streaming.voxels import stream_voxels


def points(spark, n, seed):
    return spark.range(n).selectExpr("id AS pid", *[f"float(rand({seed * 3 + k}) * 4) AS {c}" for k, c in enumerate("xyz")])


def run(stream, target, checkpoint, batches=None):
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def test_restarted_stream_has_each_row_once(spark, tmp_path):
    folder, log, target, checkpoint = (str(tmp_path / n) for n in ("in", "log", "out", "state"))
    write_ply(points(spark, 50, 1), f"{folder}/a.ply", format="binary_little_endian")
    write_ply(points(spark, 30, 2), f"{folder}/b.ply", format="binary_big_endian")
    assert sum(run(stream_clouds(spark, folder, log, 100, 12 * 40), target, checkpoint)) == 80
    first = spark.read.parquet(target).count()
    assert first == 80
    write_ply(points(spark, 25, 3), f"{folder}/0.ply", format="binary_little_endian")  # its name comes before those that are done
    (tmp_path / "in" / "late.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + bytes(20))
    (tmp_path / "in" / ".hidden.ply").write_bytes(b"no")
    sizes = run(stream_clouds(spark, folder, log, 100, 12 * 10), target, checkpoint)
    assert sizes == [10, 10, 5]  # admitted by bytes; the unfinished file waits
    got = spark.read.parquet(target)
    assert got.count() == got.select("file", "pid").distinct().count() == 105
    assert {tuple(r) for r in got.where("file like '%/a.ply'").select("pid", "x", "y", "z").collect()} == {tuple(r) for r in points(spark, 50, 1).collect()}
    assert got.select("red", "nz", "has_normal").distinct().collect() == [(200, 1.0, False)]


def test_voxels_of_a_folder_equal_those_of_its_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(3):
        write_ply(points(spark, 60, k), f"{folder}/{k}.ply", format="binary_little_endian")
    voxels = stream_voxels(stream_clouds(spark, folder, str(tmp_path / "log")), 1.0)
    query = voxels.writeStream.outputMode("complete").format("memory").queryName("cloud_voxels").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    whole = points(spark, 60, 0).union(points(spark, 60, 1)).union(points(spark, 60, 2))
    want = {tuple(r) for r in voxel_cells(whole, (1.0, 1.0, 1.0)).select("kx", "ky", "kz", "n").collect()}
    assert {tuple(r) for r in spark.table("cloud_voxels").select("kx", "ky", "kz", "n").collect()} == want


def test_log_decides_after_a_crash(tmp_path):
    """A reader that starts anew gives the same rows for offsets that were given away, whatever has come since."""
    (tmp_path / "in").mkdir()

    def file(name, n):
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar r\nproperty uchar g\nproperty uchar b\nend_header\n"
        (tmp_path / "in" / name).write_bytes(head.encode() + b"".join(struct.pack("<3f3B", k, 0, 0, k, 1, 2) for k in range(n)))

    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "chunk": "45", "batch": "75"}
    file("b.ply", 7)
    reader = CloudsReader(options)
    assert reader.latestOffset() == {"entries": 1} and reader.latestOffset() == {"entries": 2} == reader.latestOffset()
    file("a.ply", 2)
    file("none.ply", 0)
    again = CloudsReader(options)
    parts = again.partitions({"entries": 0}, {"entries": 2})
    assert [(p.first, p.stop) for p in parts] == [(0, 3), (3, 5), (5, 7)]
    rows = [r for p in parts for b in again.read(p) for r in b.to_pylist()]
    assert [r["x"] for r in rows] == list(range(7)) == [r["red"] for r in rows] and rows[0]["kind"] == "int"
    assert again.latestOffset() == {"entries": 3} == again.latestOffset()
    assert [(p.entry["file"][-5:], p.first, p.stop) for p in again.partitions({"entries": 2}, {"entries": 3})] == [("a.ply", 0, 2)]
    (tmp_path / "in" / "text.ply").write_text("ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n")
    with pytest.raises(ValueError, match="binary file"):
        again.latestOffset()
