"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cnn, toxicity
from .audit import audit_filters
from .bpe import encode_decode
from .exact import exact_dedup
from .fmindex import substring_dedup
from .lattice import embedding_dedup
from .packing import pack
from .repair import damage, repair_plan
from .shards import shard_documents
from .simhash import simhash_dedup
from .tokens import count_tokens
from .warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def _held_out(modulus: int, remainder: int):
    """Whether a document's labels may not be learned from; a document without an id has none and is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _held_out(3, 1)
    model = cnn.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return _predicted(cnn.score_quality(docs, model), held_out)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _held_out(5, 0)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return _predicted(toxicity.score_toxicity(docs, model), held_out)


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    marked = exact_dedup(docs.select("doc_id", "text", digest))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).withColumnRenamed("kept", "kept_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), stable_scan=True)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_plan(damage(_table(spark, sf_dir, "conversations")), gone="gone")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), 16)


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_neardup, op2_quality, op3_simhash_neardup, op4_packing, op5_exact_dedup, op6_substring_dedup, op7_warc, op8_token_counts, op9_toxicity, op10_bpe_roundtrip, op11_filter_audit, op12_conversation_repair, op13_sharding)}


def oracle_sql() -> dict:
    return {
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
        """,
        "op6_substring_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM d, unnest(range(1, len(ws) - 33)) u(i)),
            again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
            covered AS (SELECT DISTINCT doc_id, i + j AS p FROM again, range(0, 35) r(j)),
            words AS (SELECT doc_id, p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) u(p)),
            kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n
                     FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
            SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
            FROM d LEFT JOIN kept USING (doc_id)
        """,
        "op11_filter_audit": r"""
            WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            f AS (SELECT doc_id, part, (len(ws) < 50)::INT AS a, (100 * len(list_distinct(ws)) < 65 * len(ws))::INT AS b,
                         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
                         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS e FROM d),
            l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
            m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
                  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
            o(filter_order, bits) AS (SELECT '', 0 UNION ALL SELECT filter_order || substr('ABCDE', k + 1, 1), bits + (1 << k) FROM o, range(5) r(k) WHERE bits & (1 << k) = 0),
            s AS (SELECT filter_order, step::INT AS step, 1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1) AS own,
                         list_sum([1 << (strpos('ABCDE', x) - 1) for x in string_split(filter_order, '')[: step - 1]]) AS before
                  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
            c AS (SELECT part, filter_order, step, own,
                         sum(n) FILTER (fails & (own + coalesce(before, 0)::INT) = 0) AS kept, sum(n) FILTER (fails & own > 0 AND fails & coalesce(before, 0)::INT = 0) AS removed,
                         sum(n) FILTER (fails & own > 0 AND fails & coalesce(before, 0)::INT > 0) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
                         sum(good) FILTER (fails & own > 0 AND fails & coalesce(before, 0)::INT = 0) AS good_lost, sum(bad) FILTER (fails & own > 0 AND fails & coalesce(before, 0)::INT = 0) AS toxic_lost
                  FROM m, s GROUP BY ALL)
            SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
                   coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
                   coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM c
        """,
    }
