"""Whole searches composed from the retrieval and ranking operators, for a table of queries at once.

``chunks(chunk_id, case_id, text, embedding)``, ``queries(query_id, text, vector)``, ``edges(src, dst)`` between cases and
``meta(case_id, court, cited_by_count)``.  Embedder and cross-encoder are inputs: vectors come as columns, and a scorer
is a function from pairs ``(query_id, case_id, chunk_id)`` to ``(query_id, case_id, rerank_score)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators import ranking
from citeloom.operators.lexical import Postings, bm25_topk
from citeloom.operators.scratch import written
from citeloom.operators.vector import cosine_topk

# Depth of the two lists, pools, gates of issue lists, groups and leads of scenarios.
DEPTH, SECTION_POOL, ISSUE_DEPTH = 200, 20, 20
CASE_GATE, SECTION_GATE, CANDIDATE_GATE = -2.0, -5.0, -4.0
ISSUE_CASES, ISSUE_SECTIONS, COMBINED_LEAD, TEXT_LEAD, TEXT_CHARS = 3, 2, 3, 7, 4000
MODES = {"hybrid": ("lexical", "vector"), "lexical": ("lexical",), "vector": ("vector",)}

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Request:
    """What may be asked; anything else raises ValueError."""

    query: str
    k: int = 10
    mode: str = "hybrid"
    courts: tuple[str, ...] = ()
    date_from: date | None = None
    date_to: date | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.query.strip()) <= TEXT_CHARS:
            raise ValueError(f"query: 1 to {TEXT_CHARS} characters")
        if not 1 <= self.k <= 50:
            raise ValueError("k: 1 to 50")
        if self.mode not in MODES:
            raise ValueError(f"mode: one of {sorted(MODES)}")
        if len(self.courts) > 30 or not all(c.isascii() and c.isalpha() and 2 <= len(c) <= 10 for c in self.courts):
            raise ValueError("courts: at most 30 codes of 2 to 10 letters")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("dates: the first must not be after the last")

    def allowed(self, cases: DataFrame) -> DataFrame:
        """Cases that pass the filters; each is optional, dates are inclusive."""
        return optional(cases, court=[c.upper() for c in self.courts] or None, decision_date=(self.date_from, self.date_to))


def optional(rows: DataFrame, **wanted: object) -> DataFrame:
    """Filters that only hold where a value is given: a value, a list of them, or a pair of inclusive bounds."""
    for name, value in wanted.items():
        if isinstance(value, tuple):
            low, high = value
            rows = rows if low is None else rows.where(F.col(name) >= F.lit(low))
            rows = rows if high is None else rows.where(F.col(name) <= F.lit(high))
        elif value is not None:
            rows = rows.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == F.lit(value))
    return rows


def hits(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", allowed: DataFrame | None = None, depth: int = DEPTH, postings: Postings | None = None) -> DataFrame:
    """``query_id, source, rank, chunk_id, case_id`` of the lists that ``mode`` asks for; filters come before the top-k."""
    mine = chunks if allowed is None else chunks.join(allowed.select("case_id"), "case_id", "left_semi")
    lists = []
    if "lexical" in MODES[mode]:
        only = None if allowed is None else mine.select(F.col("chunk_id").alias("doc_id"))
        found = bm25_topk(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), queries.select("query_id", "text"), depth, only, postings=postings)
        lists.append(found.select("query_id", F.lit("lexical").alias("source"), "rank", F.col("doc_id").alias("chunk_id")))
    if "vector" in MODES[mode]:
        found = cosine_topk(mine, queries.select("query_id", F.col("vector").alias("query")), depth, "chunk_id", "embedding")
        lists.append(found.select("query_id", F.lit("vector").alias("source"), "rank", F.col("item_id").alias("chunk_id")))
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return written(both.join(chunks.select("chunk_id", "case_id"), "chunk_id"), "hits")


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine of two array columns of a row; null where one is null or has length 0."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return 1 - product(a, b) / F.nullif(F.sqrt(product(a, a)) * F.sqrt(product(b, b)), F.lit(0.0))


def nearest_chunks(cases: DataFrame, chunks: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """The chunk of each (query_id, case_id) that is nearest to the query: ``query_id, case_id, chunk_id, dist``."""
    pairs = cases.select("query_id", "case_id").join(chunks.select("case_id", "chunk_id", "embedding"), "case_id").join(queries.select("query_id", "vector"), "query_id")
    near = pairs.select("query_id", "case_id", "chunk_id", F.round(cosine(F.col("embedding"), F.col("vector")), digits).alias("dist")).where("dist is not null")
    best = near.groupBy("query_id", "case_id").agg(F.min(F.struct("dist", "chunk_id")).alias("b"))
    return best.select("query_id", "case_id", "b.chunk_id", "b.dist")


def within_case(case_id: object, chunks: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Exact ranking of one case's chunks for each query: ``query_id, item_id, dist, rank``."""
    return cosine_topk(chunks.where(F.col("case_id") == F.lit(case_id)), queries.select("query_id", F.col("vector").alias("query")), k, "chunk_id", "embedding")


def search(
    chunks: DataFrame, queries: DataFrame, edges: DataFrame, meta: DataFrame, k: int = 10, mode: str = "hybrid", allowed: DataFrame | None = None,
    scorer: Scorer | None = None, config: ranking.RankingConfig = ranking.RankingConfig(), depth: int = DEPTH, postings: Postings | None = None,
) -> DataFrame:
    """``query_id, case_id, score, rerank_score, final_rank`` of each query's k best cases.

    Lists, fusion, graph expansion, priors and rerank blend.  Modes other than ``hybrid`` leave out graph and rerank but
    keep the priors.  Defined cases: a query without any hit has no rows; without a scorer nothing is reranked; ties in
    score go to the smaller case id.
    """
    if mode != "hybrid":
        config = replace(config, graph_weight=0.0, rerank_weight=0.0)
    known = meta if allowed is None else meta.join(allowed.select("case_id"), "case_id", "left_semi")
    found = hits(chunks, queries, mode, allowed, depth, postings)
    fused = written(ranking.fuse(found), "fused")
    ranked = ranking.expand(fused, edges, known, config) if config.graph_weight else fused
    ranked = ranking.with_priors(ranked, known, config).select("query_id", "case_id", "score")
    if scorer is None or not config.rerank_weight:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id")
        out = ranked.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.row_number().over(order))
    else:
        seeds = fused.where(F.col("position") <= ranking.SEEDS).select("query_id", F.col("case_id").alias("src"), F.col("position").alias("seed_rank"))
        reached = edges.join(known.select(F.col("case_id").alias("dst")), "dst", "left_semi")
        graph = ranking.seed_support(seeds, reached).select("query_id", F.col("dst").alias("case_id"), "graph_rank")
        only = graph.join(fused.select("query_id", "case_id"), ["query_id", "case_id"], "left_anti")
        pool = ranking.rerank_pool(fused, ranking.passages(found), only, nearest_chunks(only, chunks, queries))
        out = ranking.rerank_blend(ranked, scorer(pool), config)
    return out.where(F.col("final_rank") <= k).select("query_id", "case_id", "score", "rerank_score", "final_rank")


# --- scenarios ------------------------------------------------------------------------------------------------------


def scenario_queries(scenarios: DataFrame, with_text: bool = True, most_issues: int = 10) -> DataFrame:
    """``query_id, text``: a query's id is the struct (scenario_id, list_no) of its list.

    ``scenarios(scenario_id, text, combined, issues)``.  With the scenario's own text (its first TEXT_CHARS characters) as
    list 0 the combined query is one more list; without it, it is list 0.  Blank issues are left out.
    """
    issues = F.slice(F.filter(F.coalesce("issues", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")), 1, most_issues)
    lead = [F.substring("text", 1, TEXT_CHARS)] if with_text else []
    listed = scenarios.select("scenario_id", F.posexplode(F.concat(F.array(*lead, F.col("combined")), issues)).alias("list_no", "text"))
    return listed.select(F.struct("scenario_id", "list_no").alias("query_id"), "text").where("text is not null")


def gated_lists(found: DataFrame, floor: float = CASE_GATE) -> DataFrame:
    """``scenario_id, list_no, rank, item`` of the cases that may stand: all of list 0, of the others what passes the gate."""
    keep = (F.col("query_id.list_no") == 0) | ranking.passes_gate(F.col("rerank_score"), floor)
    return found.where(keep).select("query_id.scenario_id", "query_id.list_no", F.col("final_rank").alias("rank"), F.col("case_id").alias("item"))


def scenario_groups(lists: DataFrame, k: int = 10, lead: int = COMBINED_LEAD, per_issue: int = ISSUE_CASES) -> DataFrame:
    """``scenario_id, group_no, item, position, number, is_pointer``: the merged best k, then each issue's own best."""
    by = ["scenario_id"]
    return ranking.number_first_seen(ranking.group_issues(lists, k, lead, per_issue, by), by)


def flat_list(groups: DataFrame, key: str = "item") -> DataFrame:
    """``scenario_id, item, place``: group 0 in its order, then the others round-robin, every item once."""
    first = groups.groupBy("scenario_id", key).agg(F.min(F.struct((F.col("group_no") > 0).alias("later"), "position", "group_no")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("scenario_id").orderBy("at", key))).drop("at")


def search_scenario(
    chunks: DataFrame, queries: DataFrame, edges: DataFrame, meta: DataFrame, scorer: Scorer, k: int = 10, lead: int = TEXT_LEAD, per_issue: int = ISSUE_CASES, **options: object
) -> DataFrame:
    """Groups of each scenario from its lists' queries (``scenario_queries`` with a column ``vector``), all in one job."""
    found = search(chunks, queries, edges, meta, max(k, ISSUE_DEPTH), scorer=scorer, **options)  # type: ignore[arg-type]
    return scenario_groups(written(gated_lists(found), "lists"), k, lead, per_issue)


# --- sections -------------------------------------------------------------------------------------------------------


def section_scope(laws: DataFrame, jurisdictions: list[str], named: list[str]) -> DataFrame:
    """Laws in scope: of a jurisdiction, of the constitution, or named."""
    return laws.where(F.col("jurisdiction").isin(jurisdictions) | (F.col("kind") == "constitution") | F.col("code").isin(named))


def section_pool(lists: DataFrame, support: DataFrame, size: int = SECTION_POOL) -> DataFrame:
    """``query_id, item, place``: the first of each list, then the best supported, each once in that order.

    ``lists(query_id, source, rank, item)`` with sources lexical and vector; ``support(query_id, item, n_seeds)``.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("n_seeds"), "item")
    third = support.select("query_id", F.lit(2).alias("part"), F.row_number().over(order).alias("rank"), "item")
    parts = lists.select("query_id", F.when(F.col("source") == "lexical", 0).otherwise(1).alias("part"), "rank", "item").unionByName(third)
    first = parts.where(F.col("rank") <= size).groupBy("query_id", "item").agg(F.min(F.struct("part", "rank")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "item"))).drop("at")


def supported_sections(sections: DataFrame, named: DataFrame, floor: float = SECTION_GATE) -> DataFrame:
    """Sections of a scenario's lists that may stand.

    ``sections(scenario_id, list_no, rank, code, section_no, cited_by_count, n_seeds, rerank_score)``, ``named(scenario_id,
    code)``.  Sections that no case cites go unless their law is named; lists behind the first keep only laws that are
    named, in list 0, or have a section cited by seeds, and only what passes the gate.
    """
    law = ["scenario_id", "code"]
    # Names and sections are dealt and sorted by law once; a law that is null is neither named nor held.
    rows = sections.select(*law, *[c for c in sections.columns if c not in law])
    both = rows.withColumn("_told", F.lit(False)).unionByName(named.select(*law, F.lit(True).alias("_told")), allowMissingColumns=True)
    own, known = Window.partitionBy(*law), F.col("scenario_id").isNotNull() & F.col("code").isNotNull()
    cited = F.coalesce(F.col("cited_by_count") > 0, F.lit(False))
    counts = F.col("_told") | cited & F.coalesce((F.col("list_no") == 0) | (F.col("n_seeds") > 0), F.lit(False))
    marked = both.withColumns({"_named": known & F.max("_told").over(own), "_held": known & F.max(counts).over(own)}).where("not _told")
    kept = marked.where(F.col("_named") | cited)
    passes = F.col("_held") & ranking.passes_gate(F.col("rerank_score"), floor)
    return kept.where((F.col("list_no") == 0) | (F.col("list_no") > 0) & passes).select(*rows.columns)


def uncovered_regulations(cited: DataFrame, laws: DataFrame) -> DataFrame:
    """``citation, n_cases`` of regulations cited (``cited(case_id, citation)``) that no law's code covers."""
    return cited.distinct().join(laws.select(F.col("code").alias("citation")), "citation", "left_anti").groupBy("citation").agg(F.count(F.lit(1)).alias("n_cases"))


def related(found: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """The first k cases of each query without the query's own: ``found(query_id, case_id, final_rank)``, ``own(query_id, case_id)``."""
    others = found.join(own, ["query_id", "case_id"], "left_anti")
    return others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank"))).where(F.col("rank") <= k)


def issue_labels(groups: DataFrame) -> DataFrame:
    """``scenario_id, item, issues``: the numbers of the issue groups an item is in."""
    return groups.where("group_no > 0").groupBy("scenario_id", "item").agg(F.sort_array(F.collect_set("group_no")).alias("issues"))
