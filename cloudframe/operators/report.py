"""Reports over benchmark and statistics tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..sources.files import lines_of, write_file
from ..sources.ply import write_ply
from .mesh import quality


def benchmark_gate(before: DataFrame, after: DataFrame, tolerance: float = 0.2, least_ms: float = 0.001, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of two ``benchmark, best_ms`` tables with the ratio and a status of each."""
    a, b = before.select("benchmark", F.col("best_ms").alias("before_ms")), after.select("benchmark", F.col("best_ms").alias("after_ms"))
    ratio = F.when(F.col("before_ms") > 0, F.col("after_ms") / F.col("before_ms"))
    status = (
        F.when(F.col("benchmark").isin(list(ignored)), "ignored").when(F.col("before_ms").isNull(), "added").when(F.col("after_ms").isNull(), "missing")
        .when((F.col("before_ms") < least_ms) & (F.col("after_ms") < least_ms), "unchanged")
        .when(F.col("ratio") >= 1 + tolerance, "regressed").when(F.col("ratio") <= 1 - tolerance, "improved").otherwise("unchanged")
    )
    return a.join(b, "benchmark", "full_outer").withColumn("ratio", ratio).withColumn("status", status)


def hotspots(results: DataFrame, top: int = 10) -> DataFrame:
    """Slowest ``gpu_*`` rows of ``benchmark, best_ms`` with the time of their ``cpu_*`` twin and the ratio."""
    fast = results.where(F.col("benchmark").startswith("gpu_")).select("benchmark", "best_ms", F.concat(F.lit("cpu_"), F.substring("benchmark", 5, 1000)).alias("__twin"))
    slow = results.select(F.col("benchmark").alias("__twin"), F.col("best_ms").alias("cpu_ms"))
    ratio = F.when(F.col("cpu_ms") > 0, F.col("best_ms") / F.col("cpu_ms")).alias("ratio")
    return fast.join(slow, "__twin", "left").select("benchmark", "best_ms", "cpu_ms", ratio).orderBy(F.desc("best_ms"), "benchmark").limit(top)


def threshold_gate(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows ``path, metric, value, low, high`` of ``measured(path, metric, value)`` outside ``limits(metric, low, high)``."""
    joined = measured.join(limits, "metric")
    return joined.where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")) | F.col("value").isNull()).select("path", "metric", "value", "low", "high")


def compare_statistics(reference: DataFrame, measured: DataFrame, tolerance: float) -> DataFrame:
    """Rows of two ``path, metric, value`` tables that differ by over ``tolerance`` or are in one only."""
    a, b = reference.withColumnRenamed("value", "expected"), measured.withColumnRenamed("value", "actual")
    both = a.join(b, ["path", "metric"], "full_outer")
    return both.where(F.col("expected").isNull() | F.col("actual").isNull() | (F.abs(F.col("expected") - F.col("actual")) > tolerance))


def write_mesh_report(meshes: dict[str, tuple[DataFrame, DataFrame]], radius: float, folder: str) -> DataFrame:
    """Write each mesh as ``<name>.ply`` and the figures of all as one document ``report.json``; returns ``name`` and its figures.

    Names are those of files and keys: letters, digits, ``_`` and ``-``.
    """
    for name in meshes:
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"{name!r} is no name of a mesh")
    figures = None
    for name, (vertices, faces) in meshes.items():
        write_ply(vertices, f"{folder}/{name}.ply", faces)
        row = quality(vertices, faces, radius).select(F.lit(name).alias("name"), "*")
        figures = row if figures is None else figures.unionByName(row)
    figures = cut(figures)
    columns = [c for c in figures.columns if c != "name"]
    entry = F.concat(F.lit('  "'), F.col("name"), F.lit('": '), F.to_json(F.struct(*columns)))
    last = F.col("name") == F.lit(max(meshes))
    write_file(f"{folder}/report.json", [b"{\n", (figures.select(F.concat(entry, F.when(last, "").otherwise(",")).alias("text"), "name"), ["name"], lines_of), b"}\n"])
    return figures


def mesh_report(quality: DataFrame) -> DataFrame:
    """A one-row table of figures as one JSON document."""
    return quality.select(F.to_json(F.struct(*quality.columns)).alias("json"))
