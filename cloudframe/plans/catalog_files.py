"""Registered queries of readers and writers: a cloud is written, read back, and compared with its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import COLOR, NORMAL, XYZ
from ..operators import report
from ..sources import las, obj, ply, xyz
from ..streaming import clouds
from .catalog import query
from .inputs import E_SQL, embeddings_cloud, rounded
from .lineage import new_path

_PAINTED = f"{E_SQL}, n AS (SELECT count(*) AS n FROM e), p AS (SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, x, y, z, nx, ny, nz, label, CAST(pid % 256 AS INT) AS red, CAST(pid * 7 % 256 AS INT) AS green, CAST(255 - pid % 256 AS INT) AS blue, CAST(pid * 37 % 65536 AS INT) AS intensity FROM e)"
_FACES = "faces AS (SELECT pid AS fid, CAST(pid AS INT) AS a, CAST((pid + 1) % n AS INT) AS b, CAST((pid + 2) % n AS INT) AS c FROM p, n)"


def _painted(spark, d):
    """The embeddings cloud with colours and an intensity; its ids are dense."""
    paint = {"red": F.col("pid") % 256, "green": F.col("pid") * 7 % 256, "blue": 255 - F.col("pid") % 256}
    return embeddings_cloud(spark, d).withColumns({c: v.cast("smallint") for c, v in paint.items()} | {"intensity": (F.col("pid") * 37 % 65536).cast("int")})


def _strip(cloud):
    """A triangle for each point and the two that follow it, around the end."""
    n = cloud.count()
    return cloud.select(F.col("pid").alias("fid"), *[((F.col("pid") + k) % n).cast("int").alias(c) for k, c in enumerate("abc")])


def _whole(df):
    return df.withColumns({c: F.col(c).cast("int") for c in (*COLOR, "intensity") if c in df.columns})


for _format in ("ascii", "binary_little_endian", "binary_big_endian"):

    @query(f"ply_{_format}", f"{_PAINTED} SELECT pid, x, y, z, nx, ny, nz, label, red, green, blue, intensity FROM p")
    def _(spark, d, format=_format):
        path = new_path(spark, "cloud.ply")
        ply.write_ply(_painted(spark, d), path, format=format)
        return _whole(ply.read_ply(spark, path).points).select("pid", *XYZ, *NORMAL, "label", *COLOR, "intensity")

    @query(f"ply_faces_{_format}", f"{_PAINTED}, {_FACES} SELECT fid, a, b, c FROM faces")
    def _(spark, d, format=_format):
        path, cloud = new_path(spark, "mesh.ply"), _painted(spark, d)
        ply.write_ply(cloud.select("pid", *XYZ), path, _strip(cloud), format)
        return ply.read_ply(spark, path).faces.select("fid", "a", "b", "c")


# Polygons of three to five corners in a binary file: their places follow only from all before them.
@query("ply_polygons", f"{_PAINTED}, t AS (SELECT pid, n, unnest(range(1, 2 + pid % 3)) AS k FROM p, n) SELECT row_number() OVER (ORDER BY pid, k) - 1 AS fid, CAST(pid AS INT) AS a, CAST((pid + k) % n AS INT) AS b, CAST((pid + k + 1) % n AS INT) AS c FROM t")
def _(spark, d):
    path, cloud = new_path(spark, "polygons.ply"), _painted(spark, d)
    n = cloud.count()
    corners = F.transform(F.sequence(F.lit(0), F.col("pid") % 3 + 2), lambda k: ((F.col("pid") + k) % n).cast("int"))
    ply.write_ply(cloud.select("pid", *XYZ), path, cloud.select(F.col("pid").alias("fid"), corners.alias("corners")), "binary_little_endian")
    return ply.read_ply(spark, path).faces.select("fid", "a", "b", "c")


def _streamed(spark, d):
    path = new_path(spark, "stream.ply")
    ply.write_ply(_painted(spark, d).select("pid", *[F.col(c).cast("float").alias(c) for c in XYZ], *COLOR), path, format="binary_little_endian")
    return path


@query("ply_stream", f"{_PAINTED} SELECT pid, CAST(x AS FLOAT)::DOUBLE AS x, CAST(y AS FLOAT)::DOUBLE AS y, CAST(z AS FLOAT)::DOUBLE AS z, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 1.0::DOUBLE AS nz, red, green, blue, false AS has_normal FROM p")
def _(spark, d):
    found = ply.stream_vertices(spark, _streamed(spark, d), chunk_bytes=4096)
    return found.select("pid", *[F.col(c).cast("double").alias(c) for c in (*XYZ, *NORMAL)], *[F.col(c).cast("int").alias(c) for c in COLOR], "has_normal")


@query("ply_sample", f"{_PAINTED} SELECT pid, blue FROM p, n WHERE pid % CAST(ceil(n / 60.0) AS BIGINT) = 0")
def _(spark, d):
    return ply.sample_vertices(spark, _streamed(spark, d), 60).select("pid", F.col("blue").cast("int").alias("blue"))


# A folder of four files as a stream, a few kilobytes a task; the name of a file tells its first point.
@query("ply_folder_stream", f"{_PAINTED} SELECT pid, CAST(x AS FLOAT)::DOUBLE AS x, CAST(y AS FLOAT)::DOUBLE AS y, CAST(z AS FLOAT)::DOUBLE AS z, red, green, blue FROM p")
def _(spark, d):
    folder, out, cloud = new_path(spark, "clouds"), new_path(spark, "streamed"), _painted(spark, d)
    n = cloud.count()
    step = max(1, -(-n // 4))
    for first in range(0, n, step):
        ply.write_ply(cloud.where(F.col("pid").between(first, first + step - 1)).select("pid", *[F.col(c).cast("float").alias(c) for c in XYZ], *COLOR), f"{folder}/{first}.ply", format="binary_little_endian")
    stream = clouds.stream_clouds(spark, folder, new_path(spark, "log"), chunk_bytes=4096)
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    first = F.regexp_extract("file", r"([0-9]+)\.ply$", 1).cast("long")
    return spark.read.schema(stream.schema).parquet(out).select((F.col("pid") + first).alias("pid"), *[F.col(c).cast("double").alias(c) for c in XYZ], *[F.col(c).cast("int").alias(c) for c in COLOR])


# The report of two meshes, read back from the files that it wrote.
@query("mesh_report_files", f"{_PAINTED}, {_FACES}, w AS (SELECT count(*) AS vertices, max(greatest(abs(x), abs(y), abs(z))) AS widest, max(abs(sqrt(x * x + y * y + z * z) - 2)) AS far FROM p) SELECT name, vertices, n AS faces, round(widest, 6) AS widest, round(far, 6) AS far, n AS faces_read FROM w, n, (VALUES ('back'), ('front')) t(name)")
def _(spark, d):
    folder, cloud = new_path(spark, "report"), _painted(spark, d).select("pid", *XYZ)
    strip = _strip(cloud)
    turned = strip.select("fid", F.col("a"), F.col("c").alias("b"), F.col("b").alias("c"))
    report.write_mesh_report({"front": (cloud, strip), "back": (cloud, turned)}, 2.0, folder)
    whole = spark.read.text(f"{folder}/report.json", wholetext=True).select(F.from_json("value", "map<string, struct<vertex_count: long, face_count: long, max_abs_coordinate: double, max_radius_error: double>>").alias("m"))
    read = None
    for name in ("back", "front"):
        one = ply.read_ply(spark, f"{folder}/{name}.ply").faces.agg(F.count(F.lit(1)).alias("faces_read")).withColumn("name", F.lit(name))
        read = one if read is None else read.unionByName(one)
    figures = whole.select(F.explode("m").alias("name", "f")).select("name", F.col("f.vertex_count").alias("vertices"), F.col("f.face_count").alias("faces"), F.round("f.max_abs_coordinate", 6).alias("widest"), F.round("f.max_radius_error", 6).alias("far"))
    return figures.join(read, "name")


def _obj(spark, d):
    path, cloud = new_path(spark, "mesh.obj"), _painted(spark, d)
    uv = cloud.select(F.col("pid").alias("tid"), F.col("x").alias("u"), F.col("y").alias("v"))
    faces = _strip(cloud)
    obj.write_obj(cloud, path, faces.withColumns({f"t{c}": F.col(c) for c in "abc"}), uv, "scene.mtl", "picture.png")
    return obj.read_obj(spark, path)


# Colours are written as bytes; the reader takes three that are all 0 or 1 for shares of 255, as the format wants.
@query("obj_points", f"{_PAINTED} SELECT pid, x, y, z, nx, ny, nz, red, green, blue FROM p")
def _(spark, d):
    return _whole(_obj(spark, d).points).select("pid", *XYZ, *NORMAL, *COLOR)


@query("obj_faces", f"{_PAINTED}, {_FACES} SELECT fid, a, b, c, a AS ta, b AS tb, c AS tc FROM faces")
def _(spark, d):
    return _obj(spark, d).faces.select("fid", "a", "b", "c", "ta", "tb", "tc")


@query("obj_texture", f"{_PAINTED} SELECT pid AS tid, x AS u, y AS v FROM p")
def _(spark, d):
    return _obj(spark, d).uv.select("tid", "u", "v")


_STEP = "low AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM p)"
_STEPS = ", ".join(f"round(round(({c} - {c}0) / 0.001) * 0.001 + {c}0, 6) + 0.0 AS {c}" for c in XYZ)


@query("las_format_2", f"{_PAINTED}, {_STEP} SELECT pid, {_STEPS}, red, green, blue, intensity FROM p, low")
def _(spark, d):
    path = new_path(spark, "cloud.las")
    las.write_las(_painted(spark, d), path)
    return _whole(las.read_las(spark, path)).select("pid", *[rounded(c).alias(c) for c in XYZ], *COLOR, "intensity")


@query("las_format_0", f"{_PAINTED}, {_STEP} SELECT pid, {_STEPS}, 255 AS intensity FROM p, low")
def _(spark, d):
    path = new_path(spark, "plain.las")
    las.write_las(_painted(spark, d).select("pid", *XYZ), path)
    return las.read_las(spark, path).select("pid", *[rounded(c).alias(c) for c in XYZ], F.col("intensity").cast("int").alias("intensity"))


@query("xyz_colored", f"{_PAINTED} SELECT pid, x, y, z, red, green, blue FROM p")
def _(spark, d):
    path = new_path(spark, "cloud.xyz")
    xyz.write_xyz(_painted(spark, d), path)
    return _whole(xyz.read_xyz(spark, path)).select("pid", *XYZ, *COLOR)


@query("xyz_permissive", f"{_PAINTED} SELECT pid, x, y, z FROM p")
def _(spark, d):
    path = new_path(spark, "plain.xyz")
    xyz.write_xyz(_painted(spark, d).select("pid", *XYZ), path)
    return xyz.read_xyz(spark, path, strict=False).select("pid", *XYZ)
