"""Documents to packed training sequences, in five stages.

Each stage works on all that the one before kept. A document is what one doc_id names: rows that repeat an id stay or go
together, and rows without an id are one document in this sense. Repeated rows of one id and text are dropped to one by
the exact stage. The stages up to the mix only drop rows; the mix drops and repeats them; columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcompact.llm.exact_dedup import exact_dedup
from logcompact.llm.jaccard import jaccard_components
from logcompact.llm.mixing import mix
from logcompact.llm.packing import pack
from logcompact.llm.quality import score_quality
from logcompact.llm.queries import vocabulary
from logcompact.session import Scratch

VOCABULARY, LENGTH = "word_bpe_49k.json", 2048
COPY = "__copy of the mix"


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose ids are kept."""
    ids = kept.select(F.col("doc_id").alias("_kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    rated = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, rated.where("keep"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = Scratch(spark, "exact-stage").write(exact_dedup(docs), "found")
    out = _only(docs, found.where("kept"))
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _only(docs, jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    copies = mix(docs).groupBy(F.col("doc_id").alias("_of")).agg(F.max("copies").cast("int").alias("_copies"))
    taken = docs.join(copies.where("_copies > 0"), docs["doc_id"].eqNullSafe(copies["_of"]))
    each = F.explode(F.sequence(F.lit(1), copies["_copies"])).alias(COPY)
    return taken.select(*[docs[c] for c in docs.columns], each).drop(COPY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: their pieces with places."""
    return pack(docs, vocabulary(VOCABULARY), LENGTH)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
