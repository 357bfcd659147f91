"""The ``opN_*`` queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from padaflow.llm.bpe import bpe_digests
from padaflow.llm.common import Scratch, documents
from padaflow.llm.exact_dedup import UPPER, exact_dedup
from padaflow.llm.line_dedup import line_dedup
from padaflow.llm.near_dedup import near_dedup
from padaflow.llm.packing import pack
from padaflow.llm.pii import pii
from padaflow.llm.sharding import shard
from padaflow.llm.sharding import sql as shard_sql
from padaflow.llm.topk import topk
from padaflow.llm.toxicity import toxicity
from padaflow.llm.url_filter import sql as url_sql
from padaflow.llm.url_filter import url_filter


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), Scratch(spark, "op1"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "op2"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), Scratch(spark, "op3"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), Scratch(spark, "op4"))


def packed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return pack(docs, scratch, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), Scratch(spark, "op5"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(documents(spark, sf_dir)).drop("found")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), Scratch(spark, "op7"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op8"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "op9"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir), Scratch(spark, "op10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_minhash_near_dedup,
        op2_toxicity,
        op3_byte_bpe,
        op4_sharding,
        op5_packing,
        op6_pii,
        op7_exact_dedup,
        op8_exact_topk,
        op9_url_filter,
        op10_line_dedup,
    )
    return {f.__name__: f for f in every}


SQL_OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept FROM s JOIN c ON s.doc_id = c.x
"""

SQL_OP7 = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""


SQL_OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id != c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": SQL_OP1,
        "op4_sharding": shard_sql(),
        "op7_exact_dedup": SQL_OP7,
        "op8_exact_topk": SQL_OP8,
        "op9_url_filter": url_sql(),
    }
