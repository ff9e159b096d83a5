"""LAS 1.2 files: point formats 0, 1, 2, 3 and 5 are read, 0 and 2 written."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import COLOR, XYZ, narrow16, vector, widen8
from ..operators.points import bounds, checked
from .files import SPLIT, open_input, read_records, write_file

# Fixed values of the format: header size, record length by point format, where colours begin.
HEADER = 227
LENGTH = {0: 20, 1: 28, 2: 26, 3: 34, 5: 63}
COLORS_AT = {2: 20, 3: 28, 5: 28}


def read_las(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Points ``pid, x, y, z, intensity`` and colours (16 bits narrowed to 8) where the format has them."""
    with open_input(path) as f:
        head = f.read(HEADER)
        size = f.size()
    if len(head) < HEADER or head[:4] != b"LASF":
        raise ValueError(f"LAS parse error in {path}: no LAS header")
    begin, = struct.unpack_from("<I", head, 96)
    kind, length, count = struct.unpack_from("<BHI", head, 104)
    scale, offset = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    if kind not in LENGTH:
        raise ValueError(f"LAS parse error in {path}: point format {kind} is not supported")
    if length < LENGTH[kind]:
        raise ValueError(f"LAS parse error in {path}: records of {length} bytes are too short for format {kind}")
    if begin < HEADER or begin + length * count > size:
        raise ValueError(f"LAS parse error in {path}: the file ends within its points")
    fields = [(n, "<i4", 4 * k) for k, n in enumerate(XYZ)] + [("intensity", "<u2", 12)]
    fields += [(n, "<u2", COLORS_AT[kind] + 2 * k) for k, n in enumerate(COLOR)] if kind in COLORS_AT else []
    raw = read_records(spark, path, begin, count, length, fields, split)
    xyz = {n: F.col(n).cast("double") * F.lit(scale[k]) + F.lit(offset[k]) for k, n in enumerate(XYZ)}
    return raw.withColumns(xyz | ({n: narrow16(F.col(n)) for n in COLOR} if kind in COLORS_AT else {}))


def write_las(cloud: DataFrame, path: str, scale: float = 0.001) -> None:
    """Write points in the order of ``pid``; coordinates become integers of ``scale`` above the least ones.

    Format 2 if the cloud has colours, else 0; intensity is 255 where there is none. Non-finite
    coordinates and spans of over 2^31 steps raise.
    """
    if not (scale > 0 and np.isfinite(scale)):
        raise ValueError("the scale is positive and finite")
    good = checked(cloud, "a point to be written to LAS is not finite", *vector())
    box = bounds(cloud).first()
    low = [box[f"min_{n}"] or 0.0 for n in XYZ]
    high = [box[f"max_{n}"] or 0.0 for n in XYZ]
    if any((h - m) / scale > 2**31 - 1 for m, h in zip(low, high, strict=True)):
        raise ValueError("coordinates do not fit into 32 bits at this scale")
    colored = set(COLOR) <= set(cloud.columns)
    kind = 2 if colored else 0
    head = bytearray(HEADER)
    head[:4] = b"LASF"
    struct.pack_into("<BB", head, 24, 1, 2)
    struct.pack_into("<32s32s", head, 26, b"", b"cloudframe")
    struct.pack_into("<HIIBHI", head, 94, HEADER, HEADER, 0, kind, LENGTH[kind], cloud.count())
    struct.pack_into("<I", head, 111, cloud.count())
    struct.pack_into("<6d", head, 131, scale, scale, scale, *low)
    struct.pack_into("<6d", head, 179, *(v for m, h in zip(low, high, strict=True) for v in (h, m)))
    steps = [F.round((c - F.lit(m)) / F.lit(scale)).cast("int").alias(n) for n, c, m in zip(XYZ, vector(), low, strict=True)]
    light = (F.col("intensity") if "intensity" in cloud.columns else F.lit(255)).cast("int").alias("intensity")
    colors = [widen8(F.col(c)).alias(c) for c in COLOR] if colored else []
    layout = [(n, "<i4") for n in XYZ] + [("intensity", "<u2"), ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")] + [(n, "<u2") for n in COLOR] * colored

    def encode(batch: pa.RecordBatch) -> bytes:
        out = np.zeros(batch.num_rows, np.dtype(layout))
        for name in batch.schema.names:
            out[name] = batch.column(name).to_numpy(zero_copy_only=False)
        out["flags"], out["class"] = 1, 1
        return out.tobytes()

    write_file(path, [bytes(head), (good.select(*steps, light, *colors, "pid"), ["pid"], encode)])
