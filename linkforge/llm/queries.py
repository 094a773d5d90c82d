"""Registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, toxicity
from .bpe import bpe_encode
from .exact_dedup import exact_dedup
from .itq import near_vectors
from .packing import pack
from .simhash import near_duplicates
from .storage import on_workers
from .url_filter import url_filter
from .warc import round_trip

#: Fixed rule list of the URL query: (rule, action).
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def vocabulary() -> str:
    """The public byte-level BPE file; every executor has it at this path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, action string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def id_remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(id_remainder(3) != 1))
    found = language_id.identify(docs, model)
    return found.withColumn("held_out", F.coalesce(id_remainder(3) == 1, F.lit(False)))


def op4_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected: texts whose probability of the upper grade is under one half."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(id_remainder(5) != 0))
    rated = quality.rate(docs, model, least_grade=1.0)
    return rated.select(
        "doc_id",
        F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"),
        "expected_grade",
        "tail_probability",
        (F.col("tail_probability") >= 0.5).alias("kept"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(id_remainder(5) != 0))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(table(spark, sf_dir, "documents"), vocabulary(), decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH rules(host_r, path_r, rule, verdict) AS (VALUES {", ".join(f"('{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{r}', '{a}')" for r, a in URL_RULES)}),
urls AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT u.page_id, u.host, u.path, r.rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC NULLS LAST, length(r.host_r) DESC) AS rn
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.host_r OR ends_with(u.host, '.' || r.host_r)) AND starts_with(u.path, r.path_r))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE rn = 1
"""

OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_language_id": op2_language_id,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_itq_near_dedup": op4_itq_near_dedup,
        "op5_warc": op5_warc,
        "op6_simhash": op6_simhash,
        "op7_quality": op7_quality,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_bpe": op9_bpe,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op5_warc": OP5_SQL, "op8_exact_dedup": OP8_SQL}
