"""PLY files, ASCII and binary of either byte order: points, faces, and samples of large files."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import COLOR, NORMAL, RESERVED, XYZ, color_byte, intensity_word
from ..operators.points import sample_rows
from .files import SPLIT, lines_of, open_input, read_lines, read_records, write_file
from .polygons import ListElement
from .xyz import number, require

# Names of types in headers and the numpy types (without byte order) that they stand for.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_WIDE = {"f4": "float", "f8": "double", "u2": "ushort"}


@dataclass
class Element:
    name: str
    count: int
    #: (name, numpy type) of scalars; (name, count type, item type) of lists.
    properties: list[tuple] = field(default_factory=list)

    @property
    def stride(self) -> int | None:
        """Bytes of a row, None if it holds lists."""
        return sum(int(p[1][1]) for p in self.properties) if all(len(p) == 2 for p in self.properties) else None


@dataclass
class Header:
    format: str
    elements: list[Element]
    offset: tuple[float, float, float] | None
    size: int

    def element(self, name: str) -> Element | None:
        return next((e for e in self.elements if e.name == name), None)


@dataclass
class PlyFile:
    """``faces`` is None where the file has none; ``offset`` what its comment says, applied or not."""

    points: DataFrame
    faces: DataFrame | None
    offset: tuple[float, float, float] | None


def _fail(path: str, what: str):
    raise ValueError(f"PLY parse error in {path}: {what}")


def read_header(path: str) -> Header:
    """Parse a header; what is malformed raises."""
    with open_input(path) as f:
        data = f.read(1 << 16)
        while b"end_header" not in data and (more := f.read(1 << 16)):
            data += more
    at = data.find(b"end_header")
    if not data.startswith(b"ply"):
        _fail(path, "the file does not begin with ply")
    if at < 0 or (end := data.find(b"\n", at)) < 0:
        _fail(path, "end_header is missing")
    kind, elements, offset = None, [], None
    for line in data[:at].decode("ascii", "replace").splitlines()[1:]:
        t = line.split()
        if not t or t[0] == "obj_info":
            continue
        if t[0] == "comment":
            if len(t) == 5 and t[1] == "POINT_OFFSET":
                offset = tuple(map(float, t[2:]))
        elif t[0] == "format":
            kind = t[1] if len(t) > 1 else None
        elif t[0] == "element":
            if len(t) != 3 or not t[2].isdigit():
                _fail(path, f"bad element: {line}")
            elements.append(Element(t[1], int(t[2])))
        elif t[0] == "property" and elements:
            known = [TYPES.get(x) for x in (t[2:4] if t[1:2] == ["list"] else t[1:2])]
            if None in known or len(t) != (5 if t[1] == "list" else 3):
                _fail(path, f"bad property: {line}")
            if t[1] == "list" and known[0][0] == "f":
                _fail(path, f"the count of list {t[4]} is not an integer")
            elements[-1].properties.append((t[-1], *known))
        else:
            _fail(path, f"unknown header line: {line}")
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        _fail(path, f"unknown format {kind}")
    header = Header(kind, elements, offset, end + 1)
    if (v := header.element("vertex")) is None or not set(XYZ) <= {p[0] for p in v.properties}:
        _fail(path, "a vertex element with x, y and z is required")
    names = [p[0] for p in v.properties]
    if len(set(names)) != len(names):
        _fail(path, "two vertex properties have one name")
    return header


@dataclass
class _Place:
    """Where an element of a binary file begins and, if its rows have no fixed width, where its ranges do."""

    begin: int
    rows: ListElement | None = None
    places: DataFrame | None = None


def _starts(spark: SparkSession, path: str, header: Header, split: int, wanted: tuple[str, ...]) -> dict[str, _Place]:
    """Places of the elements of a binary file. Lists are followed only if they are wanted or others come after them."""
    at, out, order = header.size, {}, ">" if "big" in header.format else "<"
    with open_input(path) as f:
        size = f.size()
    for n, e in enumerate(header.elements):
        out[e.name] = _Place(at)
        rest = header.elements[n + 1 :]
        if e.stride is not None:
            at += e.stride * e.count
        elif (width := _triangles(path, header, e, at)) is not None and _follows(path, header, n, at + width * e.count):
            at += width * e.count
        elif rest or e.name in wanted:
            # Elements of fixed width after this one leave so much less for it.
            end = size - sum(x.stride * x.count for x in rest) if all(x.stride is not None for x in rest) else size
            if end < at:
                _fail(path, "the file ends within its elements")
            rows = ListElement(path, e.properties, order, at, end, e.count, split)
            places, stop = rows.places(spark)
            out[e.name] = _Place(at, rows, places)
            at = stop
    return out


def _triangles(path: str, header: Header, e: Element, at: int) -> int | None:
    """Width of a row if the element is one list, of three items."""
    return int(e.properties[0][1][1]) + 3 * int(e.properties[0][2][1]) if len(e.properties) == 1 and len(e.properties[0]) == 3 else None


def _follows(path: str, header: Header, n: int, at: int) -> bool:
    """Whether the fixed-width rest of the file fills it exactly from here."""
    rest = header.elements[n + 1 :]
    if any(e.stride is None for e in rest):
        return False
    with open_input(path) as f:
        return at + sum(e.stride * e.count for e in rest) == f.size()


def _vertex_columns(header: Header, raw: DataFrame, offset) -> DataFrame:
    """Canonical columns: colours as bytes, gray from intensity, normals only if complete, other properties as scalars."""
    kinds = {p[0]: p[1] for p in header.element("vertex").properties}
    out = {"pid": F.col("pid")}
    for k, n in enumerate(XYZ):
        out[n] = F.col(n) + F.lit(offset[k]) if offset else F.col(n)
    if set(NORMAL) <= set(kinds):
        out |= {n: F.col(n) for n in NORMAL}
    if "intensity" in kinds:
        out["intensity"] = intensity_word(F.col("intensity"), _WIDE.get(kinds["intensity"], "int"))
    if set(COLOR) <= set(kinds):
        out |= {n: color_byte(F.col(n), _WIDE.get(kinds[n], "int")) for n in COLOR}
    elif "intensity" in kinds:
        out |= {n: color_byte(F.col("intensity"), _WIDE.get(kinds["intensity"], "int")) for n in COLOR}
    out |= {n: F.col(n).cast("double") for n in kinds if n not in RESERVED}
    return raw.select(*[c.alias(n) for n, c in out.items()])


def _fans(corners: DataFrame, path: str, points: int) -> DataFrame:
    """Faces of ``row, corners`` cut into fans, numbered in order; corners that are no points raise."""
    ok = (F.size("corners") >= 3) & F.forall("corners", lambda v: (v >= 0) & (v < points))
    corners = corners.where(require(ok, F.concat(F.lit(f"PLY parse error in {path}: a face has under three corners or one out of range: row "), F.col("row").cast("string"))))
    from ..operators.points import dense_ids

    fan = F.posexplode(F.transform(F.sequence(F.lit(2), F.size("corners") - 1), lambda k: F.struct(F.col("corners")[0].alias("a"), F.get("corners", k - 1).alias("b"), F.get("corners", k).alias("c"))))
    return dense_ids(corners.select("row", fan.alias("k", "t")).select("row", "k", "t.*"), ["row", "k"], "fid").select("fid", *[F.col(c).cast("int").alias(c) for c in "abc"])


def _ascii(spark: SparkSession, path: str, header: Header, split: int) -> tuple[DataFrame, DataFrame | None]:
    lines = read_lines(spark, path, header.size, split=split).select("line", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("t"))
    begin, found = 0, {}
    for e in header.elements:
        found[e.name] = lines.where(F.col("line").between(begin, begin + e.count - 1)).withColumn("row", F.col("line") - begin)
        begin += e.count
    among = lambda e: F.col("row").between(0, e.count - 1)
    v = header.element("vertex")
    if found["vertex"].count() < v.count:
        _fail(path, "the file ends within its vertices")
    values = [number(F.try_element_at("t", F.lit(k + 1))).cast({"f4": "float", "f8": "double"}.get(p[1], "long")).alias(p[0]) for k, p in enumerate(v.properties)]
    whole = F.col("t")[0].isNotNull() & (F.size("t") >= len(v.properties))
    rows = found["vertex"].where(require(whole, F.concat(F.lit(f"PLY parse error in {path}: too few values in vertex "), F.col("row").cast("string")), among(v)))
    raw = rows.select(F.col("row").alias("pid"), *values)
    for n in XYZ:
        raw = raw.where(require(F.col(n).isNotNull(), F.concat(F.lit(f"PLY parse error in {path}: {n} is no number in vertex "), F.col("pid").cast("string")), F.col("pid").between(0, v.count - 1)))
    e = header.element("face")
    if e is None or not e.properties:
        return raw, None
    faces, at = found["face"].withColumn("t", F.transform("t", number)), F.lit(1)
    place = next((k for k, p in enumerate(e.properties) if len(p) == 3 and p[0] in ("vertex_indices", "vertex_index")), None)
    if place is None:
        return raw, None
    for p in e.properties[:place]:  # lists before the corners have lengths of their own
        at = at + 1 if len(p) == 2 else at + 1 + F.element_at("t", at.cast("int")).cast("int")
    n = F.element_at("t", at.cast("int")).cast("int")
    items = F.slice("t", at.cast("int") + 1, n)
    good = n.isNotNull() & (F.size("t") >= at.cast("int") + n) & F.forall(items, lambda x: x.isNotNull() & (x == F.floor(x)))
    faces = faces.where(require(F.coalesce(good, F.lit(False)), F.concat(F.lit(f"PLY parse error in {path}: a bad list in face "), F.col("row").cast("string")), among(e)))
    return raw, faces.select("row", F.transform(items, lambda x: x.cast("long")).alias("corners"))


def _binary(spark: SparkSession, path: str, header: Header, split: int) -> tuple[DataFrame, DataFrame | None]:
    order = ">" if "big" in header.format else "<"
    v, e = header.element("vertex"), header.element("face")
    if v.stride is None:
        _fail(path, "vertices with lists are not supported in binary files")
    corners = next((p[0] for p in e.properties if len(p) == 3 and p[0] in ("vertex_indices", "vertex_index")), None) if e else None
    starts = _starts(spark, path, header, split, ("face",) if corners else ())
    fields, at = [], 0
    for name, kind in v.properties:
        fields.append((name, order + kind, at))
        at += int(kind[1])
    with open_input(path) as f:
        size = f.size()
    if starts["vertex"].begin + v.stride * v.count > size:
        _fail(path, "the file ends within its vertices")
    raw = read_records(spark, path, starts["vertex"].begin, v.count, v.stride, fields, split)
    if corners is None:
        return raw, None
    face = starts["face"]
    item = next(p[2] for p in e.properties if p[0] == corners)
    if item[0] == "f":
        _fail(path, "face corners are no integers")
    if face.rows is not None:
        return raw, face.rows.lists(face.places, corners)
    _, count, _ = e.properties[0]
    width, step = _triangles(path, header, e, face.begin), int(item[1])
    places = [("n", order + count, 0), *((c, order + item, int(count[1]) + k * step) for k, c in enumerate("abc"))]
    rows = read_records(spark, path, face.begin, e.count, width, places, split)
    # Counts of three at equal steps, filling the file: by induction every row is a triangle.
    return raw, rows.where(require(F.col("n") == 3, F.lit(f"PLY parse error in {path}: a bad list count"))).select(F.col("pid").alias("row"), F.array(*[F.col(c).cast("long") for c in "abc"]).alias("corners"))


def read_ply(spark: SparkSession, path: str, apply_offset: bool = True, split: int = SPLIT) -> PlyFile:
    """Points and faces of a PLY file.

    Points: ``pid, x, y, z``, normals and colours where complete (gray from an intensity where there
    are no colours), ``intensity`` and any other property as a scalar. Polygons become fans. A
    comment POINT_OFFSET is added to the coordinates unless ``apply_offset`` is false. Vertices and
    faces are read range by range; for binary polygons of mixed sizes, two jobs first find the first row of each
    range, and a file that ends within them raises at once.
    """
    header = read_header(path)
    raw, corners = (_ascii if header.format == "ascii" else _binary)(spark, path, header, split)
    points = _vertex_columns(header, raw, header.offset if apply_offset else None)
    faces = _fans(corners, path, header.element("vertex").count) if corners is not None else None
    return PlyFile(points, faces, header.offset)


def stream_vertices(spark: SparkSession, path: str, chunk_bytes: int = SPLIT) -> DataFrame:
    """Vertices of a little-endian file in chunks: ``pid, x, y, z`` as floats, normals (0, 0, 1) and colours 200 where absent, ``has_normal``.

    Short colour names r, g, b are accepted.
    """
    header = read_header(path)
    v = header.elements[0]
    if header.format != "binary_little_endian" or v.name != "vertex" or v.stride is None:
        _fail(path, "streaming needs a little-endian file that begins with plain vertices")
    raw, _ = _binary(spark, path, Header(header.format, [v], header.offset, header.size), chunk_bytes)
    raw = raw.withColumnsRenamed({s: c for s, c in zip("rgb", COLOR, strict=True) if s in raw.columns})
    kinds = {dict(zip("rgb", COLOR, strict=True)).get(p[0], p[0]): p[1] for p in v.properties}
    has = set(NORMAL) <= set(kinds)
    normals = [(F.col(n) if has else F.lit(float(n == "nz"))).cast("float").alias(n) for n in NORMAL]
    colors = [(color_byte(F.col(c), _WIDE.get(kinds[c], "int")) if c in kinds else F.lit(200).cast("smallint")).alias(c) for c in COLOR]
    return raw.select("pid", *[F.col(n).cast("float").alias(n) for n in XYZ], *normals, *colors, F.lit(has).alias("has_normal"))


def sample_vertices(spark: SparkSession, path: str, most: int) -> DataFrame:
    """At most ``most`` vertices of a file, at equal steps from the first."""
    return sample_rows(stream_vertices(spark, path), read_header(path).element("vertex").count, most)


def _polygon_encoder(order: str):
    """Rows of a byte and as many corners of four bytes."""

    def encode(batch: pa.RecordBatch) -> bytes:
        lists = batch.column(0)
        items = np.asarray(lists.flatten()).astype(order + "i4")
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)])
        begins = 4 * before[:-1] + np.arange(len(sizes))
        out = np.empty(len(sizes) + 4 * len(items), np.uint8)
        out[begins] = sizes
        at = np.repeat(begins + 1 - 4 * before[:-1], sizes) + 4 * np.arange(len(items))
        out[at[:, None] + np.arange(4)] = items.view(np.uint8).reshape(-1, 4)
        return out.tobytes()

    return encode


def write_ply(points: DataFrame, path: str, faces: DataFrame | None = None, format: str = "ascii") -> None:
    """Write a PLY file: coordinates, colours, intensity, normals, scalars, then faces; in the order of ``pid`` and ``fid``.

    Faces are triangles ``a, b, c`` or polygons ``corners`` (an array of at most 255).
    """
    if format not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown format {format}")
    order = ">" if "big" in format else "<"
    kinds = dict(points.dtypes)
    real = "f4" if all(kinds[c] == "float" for c in XYZ) else "f8"
    layout = [(c, real) for c in XYZ]
    layout += [(c, "u1") for c in COLOR] if set(COLOR) <= set(kinds) else []
    layout += [("intensity", "u2")] if "intensity" in kinds else []
    layout += [(c, real) for c in NORMAL] if set(NORMAL) <= set(kinds) else []
    layout += [(c, "f4" if kinds[c] == "float" else "f8") for c in points.columns if c not in RESERVED and c != "pid"]
    titles = {"f4": "float", "f8": "double", "u1": "uchar", "u2": "ushort"}
    head = f"ply\nformat {format} 1.0\nelement vertex {points.count()}\n" + "".join(f"property {titles[k]} {c}\n" for c, k in layout)
    if faces is not None:
        head += f"element face {faces.count()}\nproperty list uchar int vertex_indices\n"
        if polygons := "corners" in faces.columns:
            faces = faces.where(require(F.coalesce(F.size("corners"), F.lit(0)).between(0, 255) & F.forall("corners", lambda c: c.isNotNull()), F.lit("a face has over 255 corners or null ones")))
    pieces: list = [(head + "end_header\n").encode()]
    numbers = {"f4": "float", "f8": "double", "u1": "smallint", "u2": "int"}
    columns = [F.col(c).cast(numbers[k]).alias(c) for c, k in layout]
    if format == "ascii":
        pieces.append((points.select(F.concat_ws(" ", *[c.cast("string") for c in columns]).alias("text"), "pid"), ["pid"], lines_of))
        if faces is not None:
            corners = [F.size("corners"), F.array_join("corners", " ")] if polygons else [F.lit("3"), "a", "b", "c"]
            pieces.append((faces.select(F.rtrim(F.concat_ws(" ", *corners)).alias("text"), "fid"), ["fid"], lines_of))
    else:
        def encoder(fields, fixed=()):
            def encode(batch: pa.RecordBatch) -> bytes:
                out = np.zeros(batch.num_rows, np.dtype([(n, order + k) for n, k in fields]))
                for n, value in fixed:
                    out[n] = value
                for n in batch.schema.names:
                    out[n] = batch.column(n).to_numpy(zero_copy_only=False)
                return out.tobytes()

            return encode

        pieces.append((points.select(*columns, "pid"), ["pid"], encoder(layout)))
        if faces is not None and polygons:
            pieces.append((faces.select(F.col("corners").cast("array<int>").alias("corners"), "fid"), ["fid"], _polygon_encoder(order)))
        elif faces is not None:
            triangle = [("n", "u1"), *((c, "i4") for c in "abc")]
            pieces.append((faces.select(*[F.col(c).cast("int").alias(c) for c in "abc"], "fid"), ["fid"], encoder(triangle, (("n", 3),))))
    write_file(path, pieces)


__all__ = ["PlyFile", "read_header", "read_ply", "sample_vertices", "stream_vertices", "write_ply"]
