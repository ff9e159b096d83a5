"""Exact deduplication by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, numbered, renamed, save, sparse_join


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128) -> DataFrame:
    """Mark all but one row of equal texts; returns the rows of ``docs`` with three more columns.

    ``keep_id`` is the largest id among equal texts, ``group_size`` their number and ``kept`` is
    true for the row that stays. Texts are compared unchanged.

    A first scan takes byte lengths and hashes of the first ``prefix`` characters; lengths are split
    by prefix before anything moves, so no length gathers in one task. Groups of two or more survive
    and are marked in buckets that every task knows. A second scan hashes only texts of
    marked buckets in full (SHA-256) and counts them with partial aggregation; some 60 bytes a row
    move. The counts are joined back to the rows that have a partner, again by marks; the others
    stay where they are. Hashes that one row in a thousand has are sent to the
    rows, so a text that a third of all rows hold meets in no task.

    A null text counts as empty; empty texts equal each other. A null id is never the largest
    unless all ids of the group are null; then every row of the group stays, with a null
    ``keep_id``. Repeated rows with the same id and text all stay if theirs is the largest id.
    An empty table gives an empty one. Other columns pass unchanged, whatever they are called; those
    named like a new one, in any case, as ``<name>_in`` (``<name>_in_in`` if that is taken).
    """
    out_names = renamed(docs, ("keep_id", "group_size", "kept"))[0].columns
    docs, inner = numbered(docs)
    id_col, text_col = inner[id_col], inner[text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumns({"__cf_len": F.octet_length(text), "__cf_head": F.xxhash64(F.substring(text, 1, prefix))})
    survivors = base.groupBy("__cf_len", "__cf_head").count().where("count > 1")
    hashed = marked(base, survivors, ["__cf_len", "__cf_head"], "__cf_marked").withColumn("__cf_key", F.when(F.col("__cf_marked"), F.unhex(F.sha2(text, 256))))
    groups = hashed.where("__cf_marked").groupBy("__cf_key").agg(F.max(id_col).alias("__cf_keep"), F.count(F.lit(1)).alias("__cf_n"))
    groups = save(groups.where("__cf_n > 1").withColumn("__cf_size", F.col("__cf_n")), "groups")
    out = sparse_join(hashed, groups, ["__cf_key"], ["__cf_len", "__cf_head", id_col], "__cf_n")
    alone = F.col("__cf_size").isNull()
    return out.select(
        *(F.col(c).alias(n) for c, n in zip(docs.columns, out_names, strict=True)),
        F.when(alone, F.col(id_col)).otherwise(F.col("__cf_keep")).alias("keep_id"),
        F.coalesce("__cf_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col(id_col).eqNullSafe(F.col("__cf_keep"))).alias("kept"),
    )
