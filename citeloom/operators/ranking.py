"""Fusion, graph expansion, priors, rerank blend and merging of ranked lists, all keyed by ``query_id``.

One query or ten thousand run as the same job.  Every order is total: score first, then first appearance or id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the ranking.
RRF_K = 60
SEEDS, SEED_CASES, MIN_SUPPORT = 30, 20, 2
RERANK_DEPTH, POOL_PASSAGES, POOL_GRAPH, BEST_PASSAGES = 40, 2, 20, 3
COURT_PRIOR = {"SCC": 1.0, "FCA": 0.6, "CMAC": 0.5, "FC": 0.4, "TCC": 0.4}
OTHER_COURT = 0.2
COURT_CITATIONS, SECTION_CITATIONS = 10_000, 20_000
SECTION_CITATION_WEIGHT = 0.004


@dataclass(frozen=True)
class RankingConfig:
    graph_weight: float = 1.0
    court_weight: float = 0.002
    citation_weight: float = 0.004
    rerank_weight: float = 1.0
    seed_cases: int = SEED_CASES
    rerank_depth: int = RERANK_DEPTH


def _ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def collapse(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of each distinct key in its list, by first appearance: ``query_id, source, *keys, case_rank``."""
    first = hits.groupBy("query_id", "source", *keys).agg(F.min("rank").alias("first_rank"))
    return _ranked(first, ["query_id", "source"], [F.col("first_rank"), *map(F.col, keys)], "case_rank")


def fuse(hits: DataFrame, keys: list[str] | None = None, rrf_k: int = RRF_K, digits: int = 12) -> DataFrame:
    """Reciprocal-rank fusion: ``query_id, *keys, score, position`` and the rank in each source.

    ``hits(query_id, source, rank, *keys)`` with sources ``lexical`` and ``vector``.  Equal scores keep the order of
    first insertion: those of the lexical list in its order, then the others in that of the vector list.
    """
    keys = keys or ["case_id"]
    ranks = collapse(hits, keys)
    pick = lambda s: F.min(F.when(F.col("source") == s, F.col("case_rank")))
    fused = ranks.groupBy("query_id", *keys).agg(F.round(F.sum(1.0 / (rrf_k + F.col("case_rank"))), digits).alias("score"), pick("lexical").alias("lexical_rank"), pick("vector").alias("vector_rank"))
    order = [F.desc("score"), F.col("lexical_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), *map(F.col, keys)]
    return _ranked(fused, ["query_id"], order, "position")


def passages(hits: DataFrame, per_case: int = BEST_PASSAGES) -> DataFrame:
    """Best chunks of each case over both lists: ``matched_by`` (lexical first) and ``best_rank``."""
    merged = hits.groupBy("query_id", "case_id", "chunk_id").agg(F.sort_array(F.collect_set("source")).alias("matched_by"), F.min("rank").alias("best_rank"))
    best = _ranked(merged, ["query_id", "case_id"], [F.col("best_rank"), F.col("chunk_id")], "passage_no")
    return best.where(F.col("passage_no") <= per_case)


def _edges_of(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The seeds' edges, taken before anything is shuffled: a semi-join with the few seeds, then the join itself."""
    return seeds.join(edges.join(seeds.select("src").distinct(), "src", "left_semi"), "src")


def seed_support(seeds: DataFrame, edges: DataFrame, rrf_k: int = RRF_K, min_support: int = MIN_SUPPORT, digits: int = 12) -> DataFrame:
    """Targets cited by at least ``min_support`` seeds: ``query_id, dst, n_seeds, support, graph_rank``.

    ``seeds(query_id, src, seed_rank)``, ``edges(src, dst)``.  Repeated edges count once.
    """
    cited = _edges_of(seeds, edges.select("src", "dst")).distinct()
    grouped = cited.groupBy("query_id", "dst").agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.sum(1.0 / (rrf_k + F.col("seed_rank"))), digits).alias("support"))
    return _ranked(grouped.where(F.col("n_seeds") >= min_support), ["query_id"], [F.desc("support"), F.col("dst")], "graph_rank")


def expand(fused: DataFrame, edges: DataFrame, meta: DataFrame, config: RankingConfig = RankingConfig(), digits: int = 12) -> DataFrame:
    """Graph expansion: adds graph_weight/(60+graph_rank) to hits and brings in supported targets that ``meta`` has."""
    seeds = fused.where(F.col("position") <= min(SEEDS, config.seed_cases)).select("query_id", F.col("case_id").alias("src"), F.col("position").alias("seed_rank"))
    known = edges.join(meta.select(F.col("case_id").alias("dst")), "dst", "left_semi")
    graph = seed_support(seeds, known).select("query_id", F.col("dst").alias("case_id"), "n_seeds", "graph_rank")
    both = fused.join(graph, ["query_id", "case_id"], "full_outer")
    added = F.coalesce(config.graph_weight / (RRF_K + F.col("graph_rank")), F.lit(0.0))
    return both.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)) + added, digits))


def court_prior(court: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COURT_PRIOR.items() for x in pair])
    return F.coalesce(table[court], F.lit(OTHER_COURT))


def authority_prior(court: Column, cited: Column, config: RankingConfig = RankingConfig()) -> Column:
    """court_weight * prior + citation_weight * ln(1+n) / ln(1+10000)."""
    return config.court_weight * court_prior(court) + config.citation_weight * F.log1p(cited.cast("double")) / F.log1p(F.lit(float(COURT_CITATIONS)))


def with_priors(hits: DataFrame, meta: DataFrame, config: RankingConfig = RankingConfig(), digits: int = 12) -> DataFrame:
    """Adds the prior where ``meta(case_id, court, cited_by_count)`` knows the case."""
    joined = hits.join(meta.select("case_id", authority_prior(F.col("court"), F.col("cited_by_count"), config).alias("_prior")), "case_id", "left")
    return joined.withColumn("score", F.round(F.col("score") + F.coalesce("_prior", F.lit(0.0)), digits)).drop("_prior")


def rerank_pool(fused: DataFrame, best: DataFrame, graph: DataFrame, graph_passages: DataFrame) -> DataFrame:
    """Pairs for the scorer: the top cases' best passages and the nearest passage of the best graph-only cases."""
    top = fused.where(F.col("position") <= RERANK_DEPTH).join(best.where(F.col("passage_no") <= POOL_PASSAGES), ["query_id", "case_id"]).select("query_id", "case_id", "chunk_id")
    only = graph.join(fused.select("query_id", "case_id"), ["query_id", "case_id"], "left_anti")
    only = _ranked(only, ["query_id"], [F.col("graph_rank"), F.col("case_id")], "_n").where(F.col("_n") <= POOL_GRAPH)
    return top.unionByName(only.join(graph_passages, ["query_id", "case_id"]).select("query_id", "case_id", "chunk_id"))


def rerank_blend(hits: DataFrame, scores: DataFrame, config: RankingConfig = RankingConfig(), digits: int = 12) -> DataFrame:
    """Replaces the head's scores by 1/(60+position) + weight/(60+rerank_rank); the tail stays behind, unchanged.

    ``hits(query_id, case_id, score)``; ``scores(query_id, case_id, rerank_score)``, several passages a case allowed
    (the best counts).  Head cases without a score keep the first term only.
    """
    best = scores.groupBy("query_id", "case_id").agg(F.max("rerank_score").alias("rerank_score"))
    placed = _ranked(hits, ["query_id"], [F.desc("score"), F.col("case_id")], "position").join(best, ["query_id", "case_id"], "left")
    placed = placed.withColumn("is_tail", F.col("position") > config.rerank_depth)
    among = Window.partitionBy("query_id", F.col("is_tail"), F.col("rerank_score").isNull()).orderBy(F.desc("rerank_score"), "position")
    placed = placed.withColumn("rerank_rank", F.when(~F.col("is_tail") & F.col("rerank_score").isNotNull(), F.row_number().over(among)))
    blended = 1.0 / (RRF_K + F.col("position")) + F.coalesce(config.rerank_weight / (RRF_K + F.col("rerank_rank")), F.lit(0.0))
    placed = placed.withColumn("score", F.round(F.when(F.col("is_tail"), F.col("score")).otherwise(blended), digits))
    return _ranked(placed, ["query_id"], [F.col("is_tail"), F.desc("score"), F.col("position")], "final_rank")


def rank_sections(hits: DataFrame, seeds: DataFrame, edges: DataFrame, counts: DataFrame, keys: list[str], digits: int = 12) -> DataFrame:
    """Sections (composite key) by both text lists, citing seeds and a citation prior.

    ``hits(query_id, source, rank, *keys)``, ``seeds(query_id, src, seed_rank)``, ``edges(src, *keys)``,
    ``counts(*keys, cited_by_count)``.
    """
    text = fuse(hits, keys).select("query_id", *keys, F.col("score").alias("text_score"))
    cited = _edges_of(seeds, edges.select("src", *keys)).distinct().groupBy("query_id", *keys)
    graph = cited.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.sum(1.0 / (RRF_K + F.col("seed_rank"))), digits).alias("support")).where(F.col("n_seeds") >= MIN_SUPPORT)
    graph = _ranked(graph, ["query_id"], [F.desc("support"), *map(F.col, keys)], "graph_rank").select("query_id", *keys, "n_seeds", "graph_rank")
    both = text.join(graph, ["query_id", *keys], "full_outer").join(counts, keys, "left")
    prior = SECTION_CITATION_WEIGHT * F.log1p(F.coalesce("cited_by_count", F.lit(0)).cast("double")) / F.log1p(F.lit(float(SECTION_CITATIONS)))
    score = F.coalesce("text_score", F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("graph_rank")), F.lit(0.0)) + prior
    return _ranked(both.withColumn("score", F.round(score, digits)), ["query_id"], [F.desc("score"), *map(F.col, keys)], "section_rank")


def interleave(lists: DataFrame, k: int, by: list[str], key: str = "item") -> DataFrame:
    """Round-robin over ranked lists without repeats: ``*by, item, position`` for the first k.

    ``lists(*by, list_no, rank, item)``.  An item stands where (rank, list) first meets it.
    """
    first = lists.groupBy(*by, key).agg(F.min(F.struct("rank", "list_no")).alias("_at"))
    return _ranked(first, by, [F.col("_at.rank"), F.col("_at.list_no"), F.col(key)], "position").where(F.col("position") <= k).drop("_at")


def merge_issues(lists: DataFrame, k: int, lead: int, by: list[str], key: str = "item") -> DataFrame:
    """List 0's top ``lead`` first, then all lists round-robin without those, cut to k."""
    head = lists.where((F.col("list_no") == 0) & (F.col("rank") <= lead)).groupBy(*by, key).agg(F.min("rank").alias("position"))
    rest = interleave(lists, k + lead, by, key).join(head.select(*by, key), [*by, key], "left_anti")
    both = head.withColumn("_part", F.lit(0)).unionByName(rest.withColumn("_part", F.lit(1)))
    return _ranked(both, by, [F.col("_part"), F.col("position")], "position").where(F.col("position") <= k).drop("_part")


def group_issues(lists: DataFrame, k: int, lead: int, per_issue: int, by: list[str], key: str = "item") -> DataFrame:
    """Groups for display: group 0 is the merged top k, group i the issue's own first ``per_issue``."""
    merged = merge_issues(lists, k, lead, by, key).select(*by, F.lit(0).alias("group_no"), key, "position")
    own = _ranked(lists.where("list_no > 0"), [*by, "list_no"], [F.col("rank"), F.col(key)], "position").where(F.col("position") <= per_issue)
    return merged.unionByName(own.select(*by, F.col("list_no").alias("group_no"), key, "position"))


def number_first_seen(groups: DataFrame, by: list[str], key: str = "item") -> DataFrame:
    """Global numbers by first appearance; later appearances point to that number (``is_pointer``)."""
    first = groups.groupBy(*by, key).agg(F.min(F.struct("group_no", "position")).alias("_first"))
    first = _ranked(first, by, [F.col("_first.group_no"), F.col("_first.position"), F.col(key)], "number")
    joined = groups.join(first, [*by, key])
    return joined.withColumn("is_pointer", F.struct("group_no", "position") != F.col("_first")).drop("_first")


def passes_gate(score: Column, floor: float, inclusive: bool = False) -> Column:
    """Score gates; a null score fails."""
    return F.coalesce(score >= floor if inclusive else score > floor, F.lit(False))


def supported_laws(named: DataFrame, combined: DataFrame, sections: DataFrame) -> DataFrame:
    """Codes named, in the combined result, or with citing cases in any query."""
    cited = sections.where("citing_cases > 0").select("code")
    return named.select("code").unionByName(combined.select("code")).unionByName(cited).distinct()
