"""OBJ files: vertices, normals, texture coordinates, faces and material names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import COLOR, NORMAL, XYZ
from ..operators.points import dense_ids
from ..plans.lineage import cut
from .files import LINES_SPLIT, lines_of, read_lines, write_file
from .xyz import number, require

KINDS = ("v", "vt", "vn", "f", "mtllib", "usemtl")
CORNER = r"^-?[0-9]+(/-?[0-9]+|/-?[0-9]+/-?[0-9]+|//-?[0-9]+)?$"


@dataclass
class ObjFile:
    """``points(pid, x, y, z, ...)``, ``faces(fid, a, b, c[, ta, tb, tc])`` and ``uv(tid, u, v)``; what a file lacks is None."""

    points: DataFrame
    faces: DataFrame | None = None
    uv: DataFrame | None = None
    material_library: str | None = None


def _error(path: str, what: str):
    return F.concat(F.lit(f"OBJ parse error in {path}: {what}, line "), (F.col("line") + 1).cast("string"))


def _field(name: str):
    return lambda x: x[name]


def _corners(tokens: str):
    """The corners of a face as places of vertex, texture and normal; each part of a corner is read once."""
    bases = F.array(*[F.col("seen")[KINDS.index(k)] for k in ("v", "vt", "vn")])
    place = lambda value, base: F.when(value > 0, value - 1).when(value < 0, base + value).when(value == 0, F.lit(-1).cast("long"))
    parts = F.transform(tokens, lambda x: F.zip_with(F.transform(F.split(x, "/"), lambda r: r.try_cast("long")), bases, place))
    return F.transform(parts, lambda i: F.struct(*[F.get(i, F.lit(k)).alias(c) for k, c in enumerate("ptn")]))


def read_obj(spark: SparkSession, path: str, split: int = LINES_SPLIT) -> ObjFile:
    """Read an OBJ file range by range.

    Of further numbers after the coordinates the last three are colours, scaled if all three are at
    most one; colours stay only if every vertex has them. Negative indices count back from their
    line. Polygons become fans. A vertex takes the normal of its face corners if these agree;
    failing that, normals go by order if there is one for each vertex. Texture indices stay only if
    every corner has one. Unknown lines are skipped; malformed ones raise, naming the line.
    """
    lines = read_lines(spark, path, kinds=KINDS, split=split).where("kind is not null")
    lines = lines.select("line", "kind", "seen", F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 2, 2**30).alias("t"))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    made = {"n": F.when(of("v", "vt", "vn"), F.transform("t", number)), "c": F.when(of("f"), _corners("t")), "shape": F.when(of("f"), F.forall("t", lambda x: x.rlike(CORNER)))}
    # The file is read, split and parsed once; the sections are plans over what was written.
    lines = cut(lines.select("line", "kind", "seen", F.when(of("mtllib"), F.col("t")).alias("t"), *[e.alias(c) for c, e in made.items()]))
    counts = {r["kind"]: r["count"] for r in lines.groupBy("kind").count().collect()}  # a row for each kind
    nth = lambda k: F.col("seen")[KINDS.index(k)]

    def numbered(kind: str, least: int, what: str):
        rows = lines.where(F.col("kind") == kind).select("kind", "line", nth(kind).alias("id"), "n")
        ok = (F.size("n") >= least) & F.forall(F.slice("n", 1, least), lambda v: v.isNotNull())
        return rows.where(require(ok, _error(path, what), F.col("kind") == kind))

    v = numbered("v", 3, "a vertex needs three numbers")
    some = (F.size("n") >= 6) & F.forall(F.slice("n", -3, 3), lambda c: c.isNotNull())
    colored = v.agg(F.coalesce(F.min(some), F.lit(False))).first()[0]
    columns = [F.col("n")[k].alias(c) for k, c in enumerate(XYZ)]
    if colored:
        last = [F.element_at("n", k - 3) for k in range(3)]
        unit = F.forall(F.slice("n", -3, 3), lambda c: (c >= 0) & (c <= 1))
        columns += [F.least(F.greatest(F.round(F.when(unit, c * 255).otherwise(c)), F.lit(0.0)), F.lit(255.0)).cast("smallint").alias(n) for n, c in zip(COLOR, last, strict=True)]
    points = v.select(F.col("id").alias("pid"), *columns)
    vn = numbered("vn", 3, "a normal needs three numbers").select(F.col("id").alias("nid"), *[F.col("n")[k].alias(c) for k, c in enumerate(NORMAL)])
    uv = numbered("vt", 2, "a texture coordinate needs two numbers").select(F.col("id").alias("tid"), F.col("n")[0].alias("u"), F.col("n")[1].alias("v")) if counts.get("vt") else None

    faces = None
    if counts.get("f"):
        face = F.col("kind") == "f"
        f = lines.where(face).where(require(F.size("c") >= 3, _error(path, "a face needs three corners"), face))
        f = f.where(require(F.col("shape"), _error(path, "a malformed corner"), face & (F.size("c") >= 3)))
        f = f.select("line", "kind", "c")
        inside = F.lit(True)
        for name, kind in (("p", "v"), ("t", "vt"), ("n", "vn")):
            found = F.transform("c", _field(name))
            inside = inside & F.coalesce(F.array_min(found) >= 0, F.lit(True)) & F.coalesce(F.array_max(found) < counts.get(kind, 0), F.lit(True))
        f = f.where(require(inside, _error(path, "an index is out of range"), face))
        fan = F.transform(F.sequence(F.lit(2), F.size("c") - 1), lambda k: F.struct(F.col("c")[0].alias("a"), F.get("c", k - 1).alias("b"), F.get("c", k).alias("c")))
        triangles = f.select("line", F.posexplode(fan).alias("k", "t")).select("line", "k", "t.*")
        textured = f.agg(F.min(F.forall("c", lambda x: x["t"].isNotNull()))).first()[0]
        named = dense_ids(triangles, ["line", "k"], "fid")
        faces = named.select("fid", *[F.col(f"{c}.p").cast("int").alias(c) for c in "abc"], *[F.col(f"{c}.t").cast("int").alias(f"t{c}") for c in "abc" if textured])
        corners = f.select(F.explode("c").alias("c")).select("c.*")
    if counts.get("vn"):
        points = _with_normals(points, vn, corners if faces is not None else None, counts)
    library = lines.where("kind = 'mtllib'").orderBy("line").limit(1).select(F.concat_ws(" ", "t").alias("name")).collect()
    return ObjFile(points, faces, uv, library[0][0] if library else None)


def _with_normals(points: DataFrame, vn: DataFrame, corners: DataFrame | None, counts: dict) -> DataFrame:
    """Normals by corners if every vertex gets one and only one, else by order if that fits, else none."""
    by_order = points.join(vn.withColumnRenamed("nid", "pid"), "pid", "left")
    same = counts["vn"] == counts["v"]
    if corners is None:
        return by_order if same else points
    each = corners.groupBy("p").agg(F.count_distinct("n").alias("ways"), F.min("n").alias("nid"))
    found = points.select("pid").join(each, F.col("pid") == F.col("p"), "left")
    row = found.agg(F.coalesce(F.max("ways"), F.lit(0)).alias("most"), F.count(F.when(F.col("nid").isNull(), 1)).alias("lacking"), F.count(F.when(F.col("nid").isNull() & F.col("p").isNotNull(), 1)).alias("used")).first()
    if row["most"] > 1 or (row["lacking"] and (row["used"] or not same)):
        return by_order if same and row["most"] == 0 else points
    chosen = found.select("pid", F.coalesce("nid", "pid").alias("nid"))
    return points.join(chosen, "pid").join(vn, "nid", "left").drop("nid")


def write_obj(points: DataFrame, path: str, faces: DataFrame | None = None, uv: DataFrame | None = None, material_library: str | None = None, texture: str | None = None) -> None:
    """Write an OBJ file in the order of ``pid``, ``tid`` and ``fid``; a material is used if both names are given."""
    text = lambda prefix, columns: F.concat_ws(" ", F.lit(prefix), *[c.cast("string") for c in columns]).alias("text")
    colored, normals = set(COLOR) <= set(points.columns), set(NORMAL) <= set(points.columns)
    used = bool(material_library and texture)
    pieces: list = [f"mtllib {material_library}\n".encode()] if material_library else []
    pieces.append((points.select(text("v", [F.col(c) for c in (*XYZ, *(COLOR if colored else ()))]), "pid"), ["pid"], lines_of))
    if normals:
        pieces.append((points.select(text("vn", [F.col(c) for c in NORMAL]), "pid"), ["pid"], lines_of))
    if uv is not None:
        pieces.append((uv.select(text("vt", [F.col("u"), F.col("v")]), "tid"), ["tid"], lines_of))
    if faces is not None:
        pieces += [b"usemtl material0\n"] * used
        textured = uv is not None and {"ta", "tb", "tc"} <= set(faces.columns)

        def corner(c):
            p = (F.col(c) + 1).cast("string")
            t = (F.col(f"t{c}") + 1).cast("string") if textured else F.lit("")
            return F.concat_ws("/", p, t, p) if normals else F.concat_ws("/", p, t) if textured else p

        pieces.append((faces.select(text("f", [corner(c) for c in "abc"]), "fid"), ["fid"], lines_of))
    write_file(path, pieces)
