"""The registered queries: each operator over its whole table, with the parameters it would run with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import (
    bpe,
    centroids,
    chat,
    divergence,
    extraction,
    fingerprints,
    line_dedup,
    minhash,
    mixing,
    quality_model,
    quality_rules,
    secret_scan,
    sharding,
)
from ledgerline.llm.common import ship
from ledgerline.llm.expected import EXPECTED

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator(*(table(spark, sf_dir, name) for name in names))

    return query


QUERIES = {
    "op1_chat_format": _over(chat.formatted, "conversations"),
    "op2_mix_sources": _over(lambda documents: mixing.mix(documents).drop("source"), "documents"),
    "op3_shard_documents": _over(sharding.sharded, "documents"),
    "op4_near_duplicates": _over(minhash.near_duplicates, "documents"),
    "op5_quality_classifier": _over(quality_model.scored, "documents", "labels"),
    "op6_quality_rules": _over(quality_rules.digest, "documents", "labels"),
    "op7_extract_pages": _over(extraction.extracted, "pages"),
    "op8_fingerprints": _over(fingerprints.compared, "documents"),
    "op8_similar_documents": _over(fingerprints.similar, "documents"),
    "op9_line_dedup": _over(line_dedup.digest, "documents"),
    "op10_bpe": _over(lambda documents: bpe.digest(documents, tokenizer_path()), "documents"),
    "op11_source_divergence": _over(divergence.divergences, "documents"),
    "op12_secret_scan": _over(lambda documents: secret_scan.digest(documents, tokenizer_path(RANKS)), "documents"),
    "op13_centroids": _over(centroids.clustered, "embeddings"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(EXPECTED)
