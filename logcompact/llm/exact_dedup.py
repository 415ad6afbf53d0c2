"""Exact duplicates by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcompact.llm.common import WHITE, text_or_empty
from logcompact.session import Scratch

#: A chunk ends at the first mark after so many characters, and at so many in any case.
SHORTEST, LONGEST = 512, 4096
MARKS = r"[.,;:!?)\]|]"


def chunked(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Pieces of a text that end where its content says: an insertion changes the pieces around it only."""
    cut = rf"(?s).{{{shortest},{longest - 1}}}?{MARKS}|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """Per row: doc_id, cp (code points of the text), text_sha256, chunks (short id, length and SHA-256 of each)."""
    short = lambda c: F.xxhash64(c) if id_bits >= 64 else F.pmod(F.xxhash64(c), F.lit(2**id_bits))
    rows = docs.select("doc_id", text_or_empty().alias("_text"))
    rows = rows.select("doc_id", F.char_length("_text").alias("cp"), F.regexp_replace("_text", WHITE, "").alias("_norm"))
    pieces = F.transform(
        chunked(F.col("_norm")),
        lambda c: F.struct(short(c).alias("h"), F.length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("digest")),
    )
    return rows.select("doc_id", "cp", F.sha2("_norm", 256).alias("text_sha256"), pieces.alias("chunks"))


def exact_dedup(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """Groups of rows whose texts are equal once white space is deleted; of each, the longest original stays.

    The chunks of every text get short identifiers (hash and length). An identifier under which two digests meet is no
    identity; chunks of such ones carry their digest besides. What is compared between documents is then the ordered
    list of identifiers, a few bytes for each 512 to 4096 characters, so no text moves between machines at all.

    Null texts count as empty; empty ones equal each other (the empty recipe). Of rows with equal length the smallest
    doc_id stays, a null doc_id last. Rows that repeat a doc_id with its text are members of one group like others, and
    all of them carry `kept` if that doc_id stays. Other columns than doc_id and text are not read. `id_bits` below 64
    is for tests, which need collisions. Runs jobs: the recipes are staged once.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.write(recipes(docs, id_bits), "recipes")
    pieces = rows.select(F.explode("chunks").alias("c")).select("c.*")
    clashes = (
        pieces.groupBy("h", "n")
        .agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        .where(F.col("lo") != F.col("hi"))
    )
    clear = clashes.limit(1).count() == 0
    part = (lambda c: F.struct(c["h"], c["n"])) if clear else (lambda c: F.struct(c["h"], c["n"], c["digest"]))
    rows = rows.withColumn("recipe", F.transform("chunks", part)).drop("chunks")
    best = F.max(F.struct("cp", (-F.col("doc_id")).alias("back"))).alias("best")
    groups = rows.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("recipe", (-F.col("best.back")).alias("keep_id"), "group_size")
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
