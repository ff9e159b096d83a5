"""Clouds made of the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from the first three components of embeddings, normals from the next three, the label as scalar."""
    e = lambda i: F.col("embedding")[i].cast("double")
    names = ("x", "y", "z", "nx", "ny", "nz")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *[e(i).alias(n) for i, n in enumerate(names)], F.col("label").cast("double").alias("label"))


def orders_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"), day.alias("z"))


def events_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), hour.alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").cast("double").alias("z"))


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without ids: quantity, discount, price."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """A figure rounded for comparison, without minus zero."""
    return F.round(c, digits) + F.lit(0.0)


#: The same clouds in DuckDB.
E_SQL = """e AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
    CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz, CAST(label AS DOUBLE) AS label FROM embeddings)"""
O_SQL = "o AS (SELECT o_orderkey AS pid, CAST(o_custkey AS DOUBLE) AS x, o_totalprice / 1000 AS y, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS z FROM orders)"
V_SQL = "v AS (SELECT event_id AS pid, floor(epoch(ts) / 3600) AS x, CAST(user_id AS DOUBLE) AS y, value AS z FROM events)"
L_SQL = "l AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z FROM lineitem)"
