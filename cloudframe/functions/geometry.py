"""Column helpers: vectors, finiteness, colours. Coordinates are widened to double before arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")
COLOR = ("red", "green", "blue")
#: Column names that no scalar field may take.
RESERVED = frozenset((*XYZ, *NORMAL, *COLOR, "intensity"))


def vector(names: Sequence[str] = XYZ, of: str = "") -> tuple[Column, ...]:
    """The named columns, as doubles; ``of`` is an alias to prefix."""
    return tuple(F.col(f"{of}.{n}" if of else n).cast("double") for n in names)


def finite(*columns: Column) -> Column:
    """Neither null, NaN nor infinite (``abs(c) < inf`` is false for NaN, which Spark sorts above infinity)."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))
    return out


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def minus(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def cross(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return norm(minus(a, b))


def face_normal(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Normal of a triangle, twice its area long."""
    return cross(minus(b, a), minus(c, a))


def cell(c: Column, size: float, origin: Column | float = 0.0) -> Column:
    """Index of the grid cell of a coordinate, by floor division in double precision."""
    shifted = c.cast("double") if isinstance(origin, float) and origin == 0.0 else c.cast("double") - origin
    return F.floor(shifted / F.lit(float(size))).cast("long")


def color_byte(value: Column, kind: str) -> Column:
    """A colour of a point file as 0..255: unit floats are scaled, 16-bit words narrowed, others clamped."""
    v = value.cast("double")
    byte = F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(255.0))
    if kind in ("float", "double"):
        byte = F.when((v >= 0) & (v <= 1), F.round(v * 255)).otherwise(byte)
    elif kind == "ushort":
        byte = F.floor((F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(65535.0)) + 128) / 257)
    return F.when(F.isnan(v), F.raise_error(F.lit("a colour is not a number"))).otherwise(byte).cast("smallint")


def intensity_word(value: Column, kind: str) -> Column:
    """An intensity as 0..65535; unit floats are scaled."""
    v = value.cast("double")
    word = F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(65535.0))
    if kind in ("float", "double"):
        word = F.when((v >= 0) & (v <= 1), F.round(v * 65535)).otherwise(word)
    return F.when(F.isnan(v), F.raise_error(F.lit("an intensity is not a number"))).otherwise(word).cast("int")


def narrow16(value: Column) -> Column:
    """A 16-bit colour as 8 bits."""
    return F.floor((value + 128) / 257).cast("smallint")


def widen8(value: Column) -> Column:
    """An 8-bit colour as 16 bits."""
    return (value.cast("int") * 257).cast("int")
