"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcompact.llm import sql
from logcompact.llm.common import documents
from logcompact.llm.divergence import audit_sources
from logcompact.llm.embedding_dedup import near_duplicates
from logcompact.llm.exact_dedup import exact_dedup
from logcompact.llm.jaccard import jaccard_components
from logcompact.llm.language import identify
from logcompact.llm.mixing import mix
from logcompact.llm.nearest import nearest_vectors
from logcompact.llm.packing import pack
from logcompact.llm.pii import find_pii
from logcompact.llm.quality import score_quality
from logcompact.llm.sharding import shard_groups
from logcompact.llm.vector_codes import compress, with_label_errors
from logcompact.llm.wordpiece import count_pieces

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """A file of the public tokenizers, read by the driver and sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), vocabulary("word_bpe_49k.json"), 2048)


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(documents(spark, folder))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_groups(documents(spark, folder), 16)


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(documents(spark, folder))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mix(documents(spark, folder))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def word_pieces() -> list[bytes]:
    """The byte strings of a public vocabulary, in which a piece at the front of a word begins with a space."""
    import base64

    return [base64.b64decode(line.split()[0]) for line in vocabulary("byte_bpe_50k.tiktoken").splitlines()]


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_pieces(documents(spark, folder), word_pieces())


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return with_label_errors(found.codes).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")
    )


def op12_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(documents(spark, folder))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing, op2_jaccard_join, op3_language, op4_sharding, op5_pii, op6_exact_dedup, op7_mixing, op8_token_counts,
        op9_quality, op10_embedding_dedup, op11_vector_codes, op12_nearest, op13_divergence,
    )
}
ORACLES: dict[str, str] = {"op6_exact_dedup": sql.EXACT_DEDUP, "op11_vector_codes": sql.VECTOR_CODES, "op13_divergence": sql.DIVERGENCE}
