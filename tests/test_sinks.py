"""Single files put together by many tasks: bytes, failures, and names that are taken."""

import os

import pytest
from pyspark.sql import functions as F

from cloudframe.sources.files import AssemblyWriter, lines_of, write_file
from cloudframe.sources.ply import read_ply, write_ply


def lines(spark, n, parts=5):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"), "id")


def test_sections_and_bytes_in_order(spark, tmp_path):
    path = str(tmp_path / "deep" / "er" / "f.txt")
    empty = lines(spark, 0)
    write_file(path, [b"head\n", (lines(spark, 3000), ["id"], lines_of), b"middle\n", (empty, ["id"], lines_of), (lines(spark, 10), ["id"], lines_of), b"end"])
    want = "head\n" + "".join(f"row {k}\n" for k in range(3000)) + "middle\n" + "".join(f"row {k}\n" for k in range(10)) + "end"
    assert open(path).read() == want
    assert os.listdir(os.path.dirname(path)) == ["f.txt"]
    write_file(path, [(lines(spark, 2), ["id"], lines_of)])  # a taken name is replaced
    assert open(path).read() == "row 0\nrow 1\n"


def test_failed_tasks_leave_nothing(spark, tmp_path, monkeypatch):
    path = tmp_path / "f.txt"
    path.write_text("before")

    def fails(batch):
        raise RuntimeError("no more room")

    with pytest.raises(Exception, match="no more room"):
        write_file(str(path), [b"x", (lines(spark, 100), ["id"], fails)])
    assert os.listdir(tmp_path) == ["f.txt"] and path.read_text() == "before"

    # Parts that vanish or shrink before they are copied: the copying tasks fail, the writer aborts.
    from cloudframe.sources import files

    whole = files.cut

    def shrunk(df, label="rows"):
        found = whole(df, label)
        open(found.first()["name"], "w").close()
        return found

    monkeypatch.setattr(files, "cut", shrunk)
    with pytest.raises(Exception, match="instead of"):
        write_file(str(path), [(lines(spark, 100), ["id"], lines_of)])
    assert os.listdir(tmp_path) == ["f.txt"] and path.read_text() == "before"


def test_commit_refuses_a_file_of_another_size(tmp_path):
    part = tmp_path / ".t"
    part.write_bytes(b"12345")
    writer = AssemblyWriter({"path": str(tmp_path / "f"), "temporary": str(part), "size": "6"})
    with pytest.raises(ValueError, match="5 bytes instead of 6"):
        writer.commit([])
    assert os.listdir(tmp_path) == []


def test_rows_written_twice_give_the_same_bytes(tmp_path):
    """A task that is run again, as after a lost executor, overwrites what it wrote."""
    hidden = tmp_path / ".t"
    hidden.write_bytes(b"\0" * 6)
    writer = AssemblyWriter({"path": str(tmp_path / "f"), "temporary": str(hidden), "size": "6"})
    rows = [{"name": None, "begin": 3, "size": 3, "data": b"def"}, {"name": None, "begin": 0, "size": 3, "data": b"abc"}]
    writer.write(iter(rows[:1]))
    writer.write(iter(rows))
    writer.commit([])
    assert (tmp_path / "f").read_bytes() == b"abcdef"


def test_uris(spark, tmp_path):
    path = (tmp_path / "u.ply").as_uri()
    points = spark.range(50).selectExpr("id AS pid", "double(id) x", "0D y", "0D z")
    write_ply(points, path, format="binary_big_endian")
    assert [r.x for r in read_ply(spark, path).points.orderBy("pid").collect()] == [float(k) for k in range(50)]
