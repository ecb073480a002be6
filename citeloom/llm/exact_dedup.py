"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

One pass over the texts leaves a narrow table of lengths and prefix hashes; the rounds run on it, and the full content
is read only of the rows whose group in the round before held at least two (unless every row's hash is asked for).
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import WHITE, dropped, keyed_join, stored


def normalised(text: Column) -> Column:
    """White-space runs become one space; null becomes the empty text.  Nothing is trimmed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, hash_all: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are.  The smallest id of a group stays (``kept``); ``keep_id`` names
    it.  ``text_sha256`` is computed where the last round reached the row; with ``hash_all`` for every row.

    Defined cases: a null text equals an empty one; an empty table gives an empty result; rows that repeat an id
    count in ``group_size`` and share its ``kept``; other columns of ``docs`` are ignored whatever their names; a null
    id never counts as smallest while the group holds a non-null one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    length = F.octet_length("norm").alias("n")
    prefix = F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("ph")
    full = F.sha2("norm", 256).alias("text_sha256")

    # Texts are read once into numbers; if every row's hash is asked for, it is taken in the same pass.
    narrow = stored(rows.select("doc_id", length, prefix, *([full] if hash_all else [])), "dedup-narrow")
    # Round 1: only lengths that occur twice go on.
    lengths = stored(narrow.groupBy("n").count().where("count > 1").select("n"), "dedup-lengths", narrow=True)
    # Round 2: prefix hashes of the rows that have such a length.
    second = keyed_join(narrow.select("doc_id", "n", "ph"), lengths, ["n"], "left_semi", F.col("doc_id"))
    twins = stored(second.groupBy("n", "ph").count().where("count > 1").select("n", "ph"), "dedup-prefixes", narrow=True)
    dropped(lengths)
    # Round 3: the full content of rows whose length and prefix both recur.
    twin_rows = twins.count()
    content = narrow if hash_all else rows.select("doc_id", "norm", length, prefix)
    third = keyed_join(content, twins, ["n", "ph"], "left_semi", F.col("doc_id"), twin_rows)
    third = third.select("doc_id", "text_sha256") if hash_all else stored(third.select("doc_id", full), "dedup-full", narrow=True)
    groups = stored(
        third.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"),
        "dedup-groups",
        narrow=True,
    )
    out = keyed_join(narrow.select("doc_id", "text_sha256") if hash_all else third, groups, ["text_sha256"], "left", F.xxhash64("doc_id"))
    if not hash_all:
        alone = keyed_join(narrow, twins, ["n", "ph"], "left_anti", F.col("doc_id"), twin_rows).select("doc_id")
        out = out.unionByName(alone, allowMissingColumns=True)
    keep = F.coalesce("keep_id", "doc_id")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay."""
    gone = stored(exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct(), "dedup-gone", narrow=True)
    return keyed_join(docs, gone, [id_col], "left_anti")
