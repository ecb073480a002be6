"""The registered queries of the training-data operators, with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import long_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return long_texts(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.language_id import identify, learn

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = identify(docs, learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.substring import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.max_plus import decode, encode

    model = _tokenizer("piece_bpe_32k.model")
    out = decode(encode(_table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.crc32("text").cast("long").alias("decoded_crc32"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.simhash import near_groups

    out = near_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.topk import top_products

    table = _table(spark, sf_dir, "embeddings")
    return top_products(table, table.where("vec_id % 50 = 0"), k=5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.token_counts import section_tokens

    return section_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), rule="first")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), hash_all=True)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.sharding import shard_by_bytes

    out = shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.html_lstm import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_topk": op5_topk,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_html_text": op9_html_text,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
        p AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
        f AS (SELECT h, min(doc_id) AS m FROM p GROUP BY h),
        gone AS (
            SELECT DISTINCT doc_id, i + k AS at
            FROM (SELECT p.doc_id, p.i, unnest(range(0, 50)) AS k FROM p JOIN f USING (h) WHERE f.m < p.doc_id)),
        each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM w),
        kept AS (
            SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.at) AS text
            FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.at = g.at GROUP BY e.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_exact_dedup": r"""
        WITH h AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM h WINDOW g AS (PARTITION BY text_sha256)""",
}
