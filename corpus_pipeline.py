"""From raw documents to packed sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it to the shared
folder and gives what was written to the next. All stages but the last return the columns of
``documents``.

``docs`` has ``doc_id`` and ``text``; all other columns, whatever their names, pass untouched (but
``n_chars``, which follows the text where a stage changes it): stages carry them as one column and
work by id and text. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.llm import cnn
from cloudframe.llm.common import save
from cloudframe.llm.exact import exact_dedup
from cloudframe.llm.fmindex import substring_dedup
from cloudframe.llm.jaccard import jaccard_dedup
from cloudframe.llm.packing import pack

_REST = "__cf_rest"


def _narrow(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and everything else in one column, so that no name can clash with what an operator adds."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("int")).alias(_REST))


def _wide(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col(_REST)[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier (op 2) rejects: those that score below 0.5.

    Null texts are scored as empty ones; a row with a null id is scored like others, and repeated
    rows are judged alike. Labels are learned from ``labels`` of ``sf_dir`` as in op 2; without
    usable labels every document scores 0.5 and stays.
    """
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = cnn.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out))
    return _wide(cnn.score_quality(_narrow(docs), model).where("score >= 0.5"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts one row, one with the largest id (op 5).

    A null text equals an empty one. Of repeated rows of that id one stays: the first by all other
    columns' text. Null ids are the smallest; if all ids of a group are null, one of its rows stays.
    """
    kept = exact_dedup(_narrow(docs)).where("kept")
    # Rows that are still equal in id and text are repeats of one document.
    alone = kept.where("group_size = 1").select("doc_id", "text", _REST)
    several = kept.where("group_size > 1").groupBy("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    first = several.agg(F.min_by(F.struct("text", _REST), F.struct(F.col("text").isNull(), F.to_json(F.struct(_REST)))).alias("r"))
    return _wide(alone.unionByName(first.select("doc_id", "r.*")), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates, five-word shingles alike to 0.8 or more, the rows with the smallest id (op 3).

    SimHash anchors show near-identical texts; what lies beyond their reach comes from further
    fingerprints (see ``jaccard``). Null and empty texts are near-duplicates of each other. A row
    with a null id stays only if no row with an id is in its group; repeated rows stay together.
    """
    return _wide(jaccard_dedup(_narrow(docs), keep_columns=True).where("doc_id <=> component_id"), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the words of passages of 35 words that occur elsewhere (op 6).

    ``n_chars`` follows where there is such a column; a text may become empty, and a null text does.
    Null ids and repeated rows are allowed: repeated rows lose each other's passages.
    """
    found = substring_dedup(_narrow(docs), with_text=True).withColumn("text", F.col("kept"))
    out = _wide(found, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences of 1024 (op 4): a row per piece, with its ids.

    Null and empty texts are their end id alone; null ids and repeated rows are packed like others.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: The network, fingerprints and tokens have no SQL form; ``tests/llm/test_pipeline.py`` holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
