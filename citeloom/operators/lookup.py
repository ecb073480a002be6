"""Case lookup: by citation, else by name, else by keywords; the first stage that finds anything wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text
from citeloom.functions.laws import trigrams, word_similarity
from citeloom.operators.lexical import bm25_topk
from citeloom.operators.scratch import written

# Fixed value: the least word similarity of a name.
LEAST_SIMILARITY = 0.6
# Digits of a score that ranks.
DIGITS = 6


@F.pandas_udf(T.ArrayType(T.StringType()))
def _trigrams(names: pd.Series) -> pd.Series:
    return names.map(lambda n: sorted(set(trigrams(n or ""))))


def by_citation(cases: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact match of the canonical form on either citation: a union of equi-joins."""
    wanted = queries.select("query_id", text.canonical(F.col("text")).alias("_c"))
    parts = [cases.join(wanted, cases[c] == wanted["_c"]).select("query_id", "case_id", "cited_by_count") for c in ("citation", "citation2")]
    return parts[0].unionByName(parts[1]).distinct().withColumn("score", F.lit(1.0))


def _first_cases(rows: DataFrame, by: list[str], order: list[Column], limit: int | None) -> DataFrame:
    if limit is None:
        return rows
    first = Window.partitionBy(*by).orderBy(*order, F.desc("cited_by_count"), "case_id")
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")


def by_name(cases: DataFrame, queries: DataFrame, least: float = LEAST_SIMILARITY, limit: int | None = None) -> DataFrame:
    """Names whose word similarity with the query is at least ``least``; all cases, or each query's first ``limit``.

    Such a name shares that part of the query's trigrams, so it has one of the query's rarest ones, as many as the rest
    and one more.  Pairs come from an equi-join on these alone, common trigrams never meet; what shares enough is scored.
    Pairs are of distinct texts and distinct names.  Cases of one name have one score, so with a ``limit`` a name's first
    ones by citations and id are all that can stand among a query's first; that many meet the texts, and the queries last.
    """
    names = written(cases.where("name is not null").select("name").distinct().select("name", _trigrams("name").alias("_nt")), "lookup-names")
    asked = queries.select(F.col("text").alias("_q")).distinct().select("_q", _trigrams("_q").alias("_ts")).where(F.size("_ts") > 0)
    each = names.select("name", F.explode("_nt").alias("_t"))
    common = each.groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    listed = asked.select("_q", F.size("_ts").alias("_n"), F.explode("_ts").alias("_t")).join(common, "_t", "left")
    rarest = Window.partitionBy("_q").orderBy(F.coalesce("_df", F.lit(0)), "_t")
    first = listed.withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= F.col("_n") - F.ceil(F.lit(least) * F.col("_n")) + 1)
    pairs = first.select("_q", "_t").join(each, "_t").select("_q", "name").distinct()
    shared = pairs.join(asked, "_q").join(names, "name").where(F.size(F.array_intersect("_ts", "_nt")) >= least * F.size("_ts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=[word_similarity(q, n) for q, n in zip(b["_q"], b["name"], strict=True)])

    near = shared.select("_q", "name").mapInPandas(run, "_q string, name string, score double").where(F.col("score") >= least)
    held = _first_cases(cases.where("name is not null").select("name", "case_id", "cited_by_count"), ["name"], [], limit)
    # Ranked on the score as the lookup rounds it, so that what ties there ties here.
    found = _first_cases(near.join(held, "name").select("_q", "case_id", "cited_by_count", "score"), ["_q"], [F.desc(F.round("score", DIGITS))], limit)
    return queries.select("query_id", F.col("text").alias("_q")).join(found, "_q").select("query_id", "case_id", "cited_by_count", "score")


def by_keywords(cases: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    found = bm25_topk(cases.select(F.col("case_id").alias("doc_id"), "text"), queries, k).withColumnRenamed("doc_id", "case_id")
    return found.join(cases.select("case_id", "cited_by_count"), "case_id").select("query_id", "case_id", "cited_by_count", "score")


def lookup(cases: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """``query_id, stage, case_id, score, rank``; ``cases(case_id, citation, citation2, name, text, cited_by_count)``.

    A stage only gets the queries that the stages before have found nothing for.
    """
    parts, left = [], queries
    for i, stage in enumerate((by_citation, lambda c, q: by_name(c, q, limit=limit), lambda c, q: by_keywords(c, q, limit))):
        found = written(stage(cases, left).select("query_id", "case_id", "cited_by_count", F.round("score", DIGITS).alias("score"), F.lit(i).alias("stage")), "lookup-stage")
        parts.append(found)
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("cited_by_count"), "case_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "stage", "case_id", "score", "rank")
