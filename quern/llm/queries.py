"""The registered queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, chat_format, embedding_dedup, exact_dedup, html_extract, language_id, mixing, secrets, simhash, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """File and pattern of the public tokenizer that op9 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, folder, "documents"), window=35, base=9)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"), keep="largest")


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, folder, "documents"), owner_col="source", repo_col="doc_id", example_owners=3, example_repos=100)


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, folder, "embeddings"), threshold=0.93)


def op5(spark: SparkSession, folder: str) -> DataFrame:
    weights = {"high": 0.8, "low": 0.18, "toxic": 0.02}
    return mixing.mix_to_targets(_table(spark, folder, "documents"), _table(spark, folder, "labels"), weights, budget=0.9)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_chats(rows.unionByName(chat_format.planted(spark))))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(_table(spark, folder, "pages"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, folder, "documents"), *vocabulary()))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, folder, "documents"), shingle=3, budget=2).select("doc_id", "fingerprint", "component_id")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1,
    "op2_exact_dedup": op2,
    "op3_secret_scan": op3,
    "op4_embedding_dedup": op4,
    "op5_mixing": op5,
    "op6_language_id": op6,
    "op7_chat_format": op7,
    "op8_html_extract": op8,
    "op9_byte_bpe": op9,
    "op10_simhash_dedup": op10,
    "pipeline": pipeline,
}

OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM s JOIN r USING (g)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, pos) GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""

OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) t(i)),
e AS (SELECT *, replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '###', '\2') AS safe,
  contains(text, '</turn>') OR contains(text, '###') OR regexp_matches(text, '\\[012]') AS odd FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(13 + length(role) + length(CASE WHEN odd THEN safe ELSE text END)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_embedding_dedup": OP4_SQL, "op7_chat_format": OP7_SQL}
