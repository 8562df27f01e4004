"""The queries opN_<name>: each operator over its whole table, with the result that its contract asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, bpe, licences, packing, perplexity, quality, rans, simhash, token_counts, toxicity
from .common import documents


def vocabulary(name: str) -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encoded_digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2)


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(documents(spark, sf_dir))


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint(found.fp).alias("fingerprint"), "component_id")


def op10_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rans_ids": op1_rans_ids,
    "op2_licence_scan": op2_licence_scan,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_lexicon_toxicity": op6_lexicon_toxicity,
    "op7_perplexity_rules": op7_perplexity_rules,
    "op8_simhash_bktree": op8_simhash_bktree,
    "op9_nbsvm_quality": op9_nbsvm_quality,
    "op10_bitsliced_topk": op10_bitsliced_topk,
}
#: The other queries have no SQL form (tokenizers, XXH64, fitted models); tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op10_bitsliced_topk": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10""",
}
