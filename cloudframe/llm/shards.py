"""Dealing documents out to numbered shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, renamed, save

#: Columns that sharding adds.
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: at most ``shards`` steps, some ln(shards) of them, for all keys at once.

    A key jumps from shard to shard as their number grows; the last jump below ``shards`` counts. So
    with one more shard a key stays or jumps into the new one, a share of 1 / (shards + 1) of them.
    """
    key, at, following = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    while (going := following < shards).any():
        at = np.where(going, following, at)
        key = np.where(going, key * np.uint64(2862933555777941757) + np.uint64(1), key)
        step = float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        following = np.where(going, np.floor((at + 1) * step).astype(np.int64), following)
    return at


def _shards(shards: int):
    def run(key: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"shard": jump_hash(key.to_numpy(), shards), "grown": jump_hash(key.to_numpy(), shards + 1)})

    return F.pandas_udf(run, "shard int, grown int")


def assign_shards(docs: DataFrame, shards: int = 16, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, grown_shard``: nothing moves, rows are decided one by one.

    The key columns and the number of shards decide (law ``key``): rows with equal keys share a
    shard, whatever else the table holds; ``grown_shard`` is the shard with one more of them, the
    same or the new one. ``size``: UTF-8 bytes of the text and one more; ``text_crc32``: of the
    text. With ``key_cols=("text",)`` equal texts share a shard.

    A null text counts as empty. A null key is a key like any other. Columns named like a new one
    (in any case) pass as ``<name>_in``. A hot key fills one shard: the law wants that.
    """
    if not 0 < shards < 1 << 31:
        raise ValueError("the number of shards is positive")
    docs, names = renamed(docs, MADE)
    text = F.coalesce(column(names[text_col]), F.lit(""))
    key = F.xxhash64(*[column(names[c]).cast("string") for c in key_cols])
    placed = docs.withColumn("__cf_at", _shards(shards)(key))
    made = {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary")), "law": F.lit("key"), "shard": F.col("__cf_at.shard"), "grown_shard": F.col("__cf_at.grown")}
    return placed.select(*[column(c) for c in docs.columns], *[c.alias(n) for n, c in made.items()])


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` of every row; see ``assign_shards``.

    ``slot`` numbers a shard's rows from 0 in the order of their ids (nulls first), without gaps.
    Texts are read once and do not move: some fifty bytes a row are written, range-partitioned by
    shard and id, and numbered where they lie; what was before in a shard, a row for each
    partition and each shard in it, is added. So a shard is numbered by many tasks. Rows of one
    id are told apart by the place in which they were written, so they spread, too.

    Repeated rows have slots of their own. An empty table gives an empty one; other columns are not
    read.
    """
    kept = assign_shards(docs.select(column(id_col).alias("__cf_id"), column(text_col).alias("__cf_text")), shards, ("__cf_id",), "__cf_text").drop("__cf_text")
    written = save(kept.withColumn("__cf_row", F.monotonically_increasing_id()), "sharded")
    order = [F.col("shard"), F.col("__cf_id").asc_nulls_first(), F.col("__cf_row")]
    there = {"__cf_part": F.spark_partition_id(), "__cf_in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    places = save(written.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(there).drop("__cf_row"), "places")
    runs = places.groupBy("__cf_part", "shard").agg(F.min("__cf_in").alias("__cf_first"), F.count(F.lit(1)).alias("__cf_n"))
    before = F.sum("__cf_n").over(Window.partitionBy("shard").orderBy("__cf_part")) - F.col("__cf_n")
    runs = runs.select("__cf_part", "shard", (before - F.col("__cf_first")).alias("__cf_shift"))
    out = places.join(F.broadcast(runs), ["__cf_part", "shard"]).withColumn("slot", F.col("__cf_in") + F.col("__cf_shift"))
    return out.select(F.col("__cf_id").alias(id_col), *MADE)


def write_shards(docs: DataFrame, path: str, shards: int = 16, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", files: int = 8) -> None:
    """Write the rows of ``docs`` as Parquet, a folder ``shard=<n>`` each, in up to ``files`` files of about equal rows a shard."""
    placed = assign_shards(docs, shards, key_cols, text_col)
    deal = F.pmod(F.xxhash64("text_crc32", "size", *[column(c) for c in key_cols if c not in MADE]), F.lit(files))
    dealt = placed.withColumn("__cf_file", deal).repartition(shards * files, "shard", "__cf_file")
    dealt.drop("__cf_file").write.partitionBy("shard").parquet(path)
