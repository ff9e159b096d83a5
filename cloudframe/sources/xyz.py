"""XYZ text files: ``x y z`` or ``x y z r g b`` a line; blank lines and lines that begin with # are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import COLOR, XYZ
from ..operators.points import dense_ids
from .files import LINES_SPLIT, lines_of, read_lines, write_file

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(token: Column) -> Column:
    """A token as a finite double, null if it is none."""
    value = F.when(token.rlike(_NUMBER), token.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def require(ok: Column, message: Column, among: Column | None = None) -> Column:
    """True, or an error; for use in ``where``. Rows that are not ``among`` those meant are left out.

    The two belong in one expression: separate conditions may be evaluated in any order.
    """
    checked = F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return checked if among is None else F.when(among, checked).otherwise(F.lit(False))


def read_xyz(spark: SparkSession, path: str, strict: bool = True, split: int = LINES_SPLIT) -> DataFrame:
    """Points ``pid, x, y, z`` and, if every row has them, ``red, green, blue``.

    ``strict``: a row that is not 3 or 6 finite numbers raises, naming its line; otherwise such a
    row is skipped and tokens after the coordinates (or colours) are ignored.
    """
    lines = read_lines(spark, path, split=split).withColumn("t", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    row = (F.trim("text") != "") & ~F.col("t")[0].startswith("#")
    values = lines.select("line", row.alias("row"), F.size("t").alias("n"), *[number(F.try_element_at("t", F.lit(k + 1))).alias(c) for k, c in enumerate((*XYZ, *COLOR))])
    point = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    color = F.col("red").isNotNull() & F.col("green").isNotNull() & F.col("blue").isNotNull()
    color = color & F.col("red").between(0, 255) & F.col("green").between(0, 255) & F.col("blue").between(0, 255)
    if strict:
        good = point & ((F.col("n") == 3) | ((F.col("n") == 6) & color))
        values = values.where(require(good, F.concat(F.lit("XYZ parse error in line "), (F.col("line") + 1).cast("string")), F.col("row")))
    else:
        values = values.where(F.col("row") & point)
    values = values.withColumn("colored", color)
    every = values.agg(F.coalesce(F.min("colored"), F.lit(False))).first()[0]
    kept = [F.round(c).cast("smallint").alias(c) for c in COLOR] if every else []
    return dense_ids(values.select("line", *XYZ, *kept), ["line"]).select("pid", *XYZ, *(COLOR if every else ()))


def write_xyz(cloud: DataFrame, path: str) -> None:
    """Write points in the order of ``pid``, with colours if the cloud has them."""
    columns = [*XYZ, *(COLOR if set(COLOR) <= set(cloud.columns) else ())]
    write_file(path, [(cloud.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("text"), "pid"), ["pid"], lines_of)])
