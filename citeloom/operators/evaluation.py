"""Retrieval metrics and a grid search over ranking weights."""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators.ranking import merge_issues

NEAR_TIE = 0.01


def score_lists(hits: DataFrame, gold: DataFrame, digits: int = 9) -> DataFrame:
    """Per query: recall@5, recall@10, reciprocal rank and nDCG@10.

    ``hits(query_id, item, rank)``, ``gold(query_id, item, gain)``; the first matching rank of a gold item counts.
    """
    first = hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    joined = gold.join(first, ["query_id", "item"], "left")
    ideal_at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item"))
    joined = joined.withColumn("ideal_rank", ideal_at)
    found = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), digits)
    dcg = F.sum(F.when(F.col("rank") <= 10, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.sum(F.when(F.col("ideal_rank") <= 10, F.col("gain") / F.log2(F.col("ideal_rank") + 1)).otherwise(0.0))
    return joined.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_gold"),
        found(5).alias("recall_5"),
        found(10).alias("recall_10"),
        found(50).alias("recall_50"),
        F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), digits).alias("mrr"),
        F.round(dcg / ideal, digits).alias("ndcg_10"),
    )


def grid(spark: SparkSession, weights: dict[str, list[float]]) -> DataFrame:
    """One row a configuration, in lexical order of the weights."""
    rows = [(i, *c) for i, c in enumerate(itertools.product(*weights.values()))]
    return spark.createDataFrame(rows, "config_id int, " + ", ".join(f"{w} double" for w in weights))


def tune(rows: DataFrame, configs: DataFrame, features: list[str], digits: int = 9) -> DataFrame:
    """Mean reciprocal rank of each configuration and the chosen one: within NEAR_TIE of the best, smallest weights.

    ``rows(query_id, item, base, gold, *features)``; a configuration has a weight of each feature's name, and an item's
    score is ``base`` plus its weighted features.  The configurations are a fixed grid, one array on every row.
    """
    packed = F.broadcast(configs.agg(F.collect_list(F.struct("*")).alias("cs")).withColumn("_one", F.lit(1)))
    each = rows.withColumn("_one", F.lit(1)).join(packed, "_one").select("query_id", "item", "base", "gold", *features, F.explode("cs").alias("c"))
    score = F.col("base")
    for f in features:
        score = score + F.col(f"c.{f}") * F.col(f)
    order = Window.partitionBy("c.config_id", "query_id").orderBy(F.desc("s"), "item")
    ranked = each.withColumn("s", F.round(score, digits)).withColumn("rank", F.row_number().over(order))
    first = ranked.where("gold").groupBy(F.col("c.config_id").alias("config_id"), "query_id").agg(F.min("rank").alias("first"))
    mean = first.groupBy("config_id").agg(F.round(F.avg(1.0 / F.col("first")), digits).alias("mrr"))
    weight = sum((F.col(f) for f in features), F.lit(0.0))
    joined = mean.join(F.broadcast(configs), "config_id").withColumn("weight", weight)
    best = joined.agg(F.max("mrr").alias("best")).withColumn("_one", F.lit(1))
    near = joined.withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one").withColumn("near", F.col("mrr") >= F.col("best") - NEAR_TIE)
    chosen = near.where("near").orderBy("weight", "config_id").limit(1).select("config_id", F.lit(True).alias("chosen"))
    return near.join(F.broadcast(chosen), "config_id", "left").select("config_id", "mrr", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def containing(docs: DataFrame, passages: DataFrame, block: int = 100_000) -> DataFrame:
    """``item_id, doc_id``: the documents that hold a passage word for word: ``docs(doc_id, text)``, ``passages(item_id, text)``.

    Passages are a stated set: counted, and in blocks of at most about ``block`` they become one automaton that a task
    runs over its documents, so nothing is paired that doesn't match.  Null and empty passages are in no document.
    """
    rows = passages.where("text is not null and text != ''").select("item_id", "text")
    blocks = max(1, -(-rows.count() // block))
    kinds = {**dict(docs.dtypes), **dict(rows.dtypes)}
    out = None
    for b in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        held = docs.sparkSession.sparkContext.broadcast((mine["item_id"].combine_chunks(), mine["text"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, texts = held.value
            search = ahocorasick.Automaton()
            owners: dict[str, list[int]] = {}
            for i, t in enumerate(texts):
                owners.setdefault(t, []).append(i)
            for t, own in owners.items():
                search.add_word(t, own)
            if not owners:
                return
            search.make_automaton()
            for batch in batches:
                found = [(r, i) for r, t in enumerate(batch.column(1).to_pylist()) if t for i in sorted({i for _, own in search.iter(t) for i in own})]
                take = lambda n: pa.array([x[n] for x in found], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([ids.take(take(1)), batch.column(0).take(take(0))], names=["item_id", "doc_id"])

        one = docs.select("doc_id", "text").mapInArrow(run, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}")
        out = one if out is None else out.unionByName(one)
    return out


def most_cited_pairs(references: DataFrame, most: int = 3, least: int = 2) -> DataFrame:
    """``doc_id, code, section_no, n, place``: the sections that a document names most, at least ``least`` times.

    Ties go to what is named first: ``references(doc_id, code, section_no, start)``.
    """
    counted = references.groupBy("doc_id", "code", "section_no").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("_at")).where(F.col("n") >= least)
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "_at", "code", "section_no")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_at")


def word_agreement(pairs: DataFrame, digits: int = 9) -> DataFrame:
    """``query_id, fmt, score``: agreement of two word lists as the share of words in matching runs, twice over both lengths.

    ``pairs(query_id, fmt, original, extracted)``; two texts without words agree fully.
    """

    def words(text: str | None) -> list[str]:
        return re.findall(r"[a-z0-9$%]+", (text or "").lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [difflib.SequenceMatcher(None, words(x), words(y), autojunk=False).ratio() for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["query_id", "fmt", "score"])

    kinds = dict(pairs.dtypes)
    out = pairs.select("query_id", "fmt", "original", "extracted").mapInArrow(run, f"query_id {kinds['query_id']}, fmt {kinds['fmt']}, score double")
    return out.withColumn("score", F.round("score", digits))


def compare_merges(lists: DataFrame, gold: DataFrame, strategies: dict[str, tuple[int, int]], by: str = "scenario_id") -> DataFrame:
    """Scores of several ways to merge the same lists: ``strategies`` name -> (k, lead); see ``score_lists``.

    ``lists(scenario_id, list_no, rank, item)``, ``gold(query_id, item, gain)``.
    """
    out = None
    for name, (k, lead) in strategies.items():
        merged = merge_issues(lists, k, lead, [by]).select(F.col(by).alias("query_id"), "item", F.col("position").alias("rank"))
        scored = score_lists(merged, gold).withColumn("strategy", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out


def brief_scores(gold: DataFrame, terms: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, checks, passed``: a brief against its gold one.

    ``gold(doc_id, section, least, most)`` bounds the number of items of a section; ``terms(doc_id, section, term, wanted)``
    says which terms (after normalising) a section must or must not have; ``items(doc_id, section, text)``.
    """
    by = ["doc_id", "section"]
    body = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(" ", F.collect_list(text.normalize(F.col("text")))).alias("body"))
    n = F.coalesce("n", F.lit(0))
    sizes = gold.join(body, by, "left").select("doc_id", (n.between(F.col("least"), F.col("most"))).alias("ok"))
    has = F.coalesce(F.col("body").contains(text.normalize(F.col("term"))), F.lit(False))
    found = terms.join(body, by, "left").select("doc_id", (has == F.col("wanted")).alias("ok"))
    return sizes.unionByName(found).groupBy("doc_id").agg(F.count(F.lit(1)).alias("checks"), F.count_if("ok").alias("passed"))


def flag_rate(gold: DataFrame, found: DataFrame, digits: int = 9) -> DataFrame:
    """``query_id, n_gold, rate``: share of the gold authorities that a found one names.

    ``gold(query_id, citation, name)``, ``found(query_id, citation, title)``.  One names another if its normalised
    citation contains the gold one's, or the first parties are equal; null counts as empty, an empty gold citation or
    party matches nothing.  Both sides meet by query, so a query's two short lists are compared and nothing else.
    """
    def citation(c: Column) -> Column:
        bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\(CanLII\)", "")
        return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))

    def party(c: Column) -> Column:
        first = F.split(F.trim(F.split(F.lower(F.coalesce(c, F.lit(""))), " v").getItem(0)), r"\s+").getItem(0)
        return F.regexp_replace(first, "[^a-z]", "")

    wanted = gold.select("query_id", F.col("citation").alias("gold_citation"), citation(F.col("citation")).alias("_c"), party(F.col("name")).alias("_p"))
    seen = found.select("query_id", citation(F.col("citation")).alias("_fc"), party(F.col("title")).alias("_fp"))
    hit = ((F.col("_c") != "") & F.col("_fc").contains(F.col("_c"))) | ((F.col("_p") != "") & (F.col("_p") == F.col("_fp")))
    flagged = wanted.join(seen, "query_id", "left").groupBy("query_id", "gold_citation").agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("flagged"))
    return flagged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.round(F.avg("flagged"), digits).alias("rate"))


def issue_coverage(gold: DataFrame, shown: DataFrame, digits: int = 9) -> DataFrame:
    """``query_id, tagged, covered, coverage``: issues tagged on gold items that some shown gold item covers.

    ``gold(query_id, item, issues array)``, ``shown(query_id, item)``; coverage is null without tagged issues.
    """
    here = gold.join(shown.select("query_id", "item", F.lit(True).alias("_shown")).distinct(), ["query_id", "item"], "left")
    each = here.select("query_id", F.explode_outer("issues").alias("issue"), "_shown")
    out = each.groupBy("query_id").agg(F.count_distinct("issue").alias("tagged"), F.count_distinct(F.when(F.col("_shown"), F.col("issue"))).alias("covered"))
    return out.withColumn("coverage", F.round(F.when(F.col("tagged") > 0, F.col("covered") / F.col("tagged")), digits))


def intake_scores(scores: DataFrame, floor: float = 0.95, digits: int = 9) -> DataFrame:
    """Per format: mean and least agreement and how many fall below ``floor``: ``scores(fmt, score)``."""
    return scores.groupBy("fmt").agg(F.round(F.avg("score"), digits).alias("mean"), F.min("score").alias("least"), F.count_if(F.col("score") < floor).alias("flagged"))
