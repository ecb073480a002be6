"""All registered queries of the retrieval and citation operators, and the same in SQL for DuckDB.

Tables stand in for the domain: ``documents`` for decisions, ``embeddings`` for chunk vectors, ``benchmark`` for
queries, ``lineitem`` for citation edges (order cites part), ``part`` for the cited dimension, ``conversations`` for
lists per issue, ``events`` for hourly counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import chunking, laws, text
from citeloom.operators import briefs, citator, evaluation, graph, lexical, lookup, ranking, search, vector
from citeloom.plans.catalog_sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {}


def query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    return make


# --- filters, joins, aggregates ----------------------------------------------------------------------------------


@query
def group_count_by_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def filtered_semi_join(t: Tables) -> DataFrame:
    good = t.labels.where("quality = 1").select("doc_id")
    return t.documents.where(F.col("lang").isin("en", "fr")).join(good, "doc_id", "left_semi").select("doc_id", "lang", "source")


@query
def case_filter_dates(t: Tables) -> DataFrame:
    """Optional, inclusive bounds and a list, before any ranking."""
    o = t.orders
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderdate").between("1995-01-01", "1996-12-31")).select("o_orderkey", "o_totalprice")


@query
def anti_join_unlabelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query
def exists_sample_filter(t: Tables) -> DataFrame:
    """Several predicates and an EXISTS."""
    long = t.documents.where((F.col("lang") == "en") & F.length("text").between(500, 20000))
    return long.join(t.labels.where("toxic = 0").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars")


@query
def edge_in_degree(t: Tables) -> DataFrame:
    return graph.in_degree(t.lineitem, t.part, "p_partkey", "l_partkey", "l_orderkey")


@query
def distinct_on_best(t: Tables) -> DataFrame:
    best = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    lines = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    top = lines.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    return top.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


@query
def four_way_citing(t: Tables) -> DataFrame:
    """For every twentieth part: the parts of its brand and type, the orders that cite them, each once, the 20 dearest."""
    kind = ["p_brand", "p_type"]
    part = t.part.select("p_partkey", *kind)
    target = part.where("p_partkey % 20 = 0").withColumnRenamed("p_partkey", "target")
    # Targets of one brand and type have the same citing orders, so these are ranked once and dealt to the targets last.
    asked = part.join(target.select(*kind).distinct(), kind, "left_semi").withColumnRenamed("p_partkey", "l_partkey")
    citing = t.lineitem.select("l_orderkey", "l_partkey").join(asked, "l_partkey").select(F.col("l_orderkey").alias("o_orderkey"), *kind)
    # Joined first, distinct then: both are dealt by order, so lines are shuffled once for the two.
    priced = t.orders.select("o_orderkey", "o_totalprice").join(citing, "o_orderkey").distinct()
    dearest = Window.partitionBy(*kind).orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = priced.withColumn("rank", F.row_number().over(dearest)).where("rank <= 20")
    return target.join(ranked, kind).select("target", "o_orderkey", "o_totalprice", "rank")


@query
def ambiguous_key_drop(t: Tables) -> DataFrame:
    return graph.unique_keys(t.part, ["p_brand", "p_type", "p_size"], "p_partkey")


@query
def citation_resolve(t: Tables) -> DataFrame:
    """Keys of line items resolved through the unambiguous ones; those that don't resolve are left out."""
    keys = graph.unique_keys(t.part, ["p_brand", "p_type", "p_size"], "p_partkey").withColumnRenamed("p_partkey", "id")
    named = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), "p_brand", "p_type", "p_size").distinct()
    return graph.resolve(named, keys, ["p_brand", "p_type", "p_size"]).select("src", "dst")


@query
def year_fallback_resolve(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority")
    keys = graph.unique_keys(o.where("o_orderpriority = '1-URGENT'"), ["o_custkey", "year"], "o_orderkey").withColumnRenamed("o_orderkey", "id")
    raw = o.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("src"), "o_custkey", "year")
    return graph.resolve_with_year_before(raw, keys, ["o_custkey"]).select("src", "dst")


@query
def range_with_fallback(t: Tables) -> DataFrame:
    refs = t.orders.select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 10).alias("at"))
    ranges = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("low"), F.col("l_extendedprice").alias("high"))
    return graph.covering_range(refs, ranges, ["l_orderkey"], "at", "low", "high", "l_linenumber").select("ref_id", "l_linenumber", "covers")


@query
def or_join_union(t: Tables) -> DataFrame:
    """Orders whose customer key or own key is the key of a customer."""
    wanted = t.customer.select(F.col("c_custkey").alias("k"))
    return graph.either_key(wanted, t.orders.select("o_orderkey", "o_custkey"), "k", ["o_custkey", "o_orderkey"], "o_orderkey").select("o_orderkey", "o_custkey")


@query
def first_wins_edges(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("position"))
    return graph.first_wins(e, ["R", "A", "N"])


@query
def best_confidence_edges(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("position"))
    return graph.best_confidence(e)


@query
def section_counts_written_back(t: Tables) -> DataFrame:
    """Distinct citing orders per (brand, type), written to every part of it; zeros stay."""
    counts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type").agg(F.countDistinct("l_orderkey").alias("cited_by_count"))
    return t.part.select("p_partkey", "p_brand", "p_type").join(counts, ["p_brand", "p_type"], "left").select("p_partkey", F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))


@query
def group_min_edges(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "p_brand").agg(F.min("p_partkey").alias("first_part"))


@query
def ingest_stats(t: Tables) -> DataFrame:
    """Per source, with a total: rows, loadable, empty, repeated, mean characters."""
    d = t.documents.select("source", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.sha2("text", 256).alias("h"))
    cube = d.rollup("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("loadable"), (F.count("h") - F.countDistinct("h")).alias("dups"), F.round(F.avg("n"), 3).alias("avg_chars"))
    return cube.withColumn("source", F.coalesce("source", F.lit("total")))


@query
def stratified_sample(t: Tables) -> DataFrame:
    """A sample by rank of a hash within each stratum."""
    order = Window.partitionBy("source").orderBy(F.md5(F.concat_ws(":", F.lit("seed1"), F.col("doc_id").cast("string"))), "doc_id")
    return t.documents.select("doc_id", "source").withColumn("rn", F.row_number().over(order)).where("rn <= 3")


@query
def latest_wins_upsert(t: Tables) -> DataFrame:
    """Upsert as union and latest row of each key."""
    order = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = t.events.select("user_id", "event_type", "event_id", "ts", "value")
    return e.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query
def hourly_rolling(t: Tables) -> DataFrame:
    """Hourly counts and the sum of the last 24 hours' buckets."""
    hours = t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("queries"), F.max("ts").alias("last_at"))
    # One row an hour, whatever the number of events; dealt by day with the day before added, so no single task.
    key = F.expr("explode(array(to_date(hour), date_add(to_date(hour), 1)))")
    dealt = hours.withColumn("day", key)
    at = Window.partitionBy("day").orderBy(F.col("hour").cast("long")).rangeBetween(-86399, 0)
    rolled = dealt.withColumn("used_24h", F.sum("queries").over(at)).where(F.col("day") == F.to_date("hour"))
    return rolled.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "queries", "used_24h")


@query
def ttl_filter(t: Tables) -> DataFrame:
    return t.events.where("ts > timestamp'2024-01-01 00:00:00' - interval 30 days").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --- text --------------------------------------------------------------------------------------------------------


@query
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.clean(F.col("text"))).alias("clean_md5"))


@query
def overlap_words(t: Tables) -> DataFrame:
    head = F.substring("text", 1, 400)
    return t.documents.select("doc_id", F.size(text.content_words(F.col("text"))).alias("n_words"), F.round(text.overlap(F.col("text"), head), 6).alias("overlap"), F.round(text.jaccard(F.col("text"), head), 6).alias("jaccard"))


@query
def content_hash_dedupe(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", text.text_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


COURTS = ["CSC", "CF", "CAF", "CFPI", "CCI", "CACM", "TCDP", "CCRI", "TCCE", "CRTFP", "TSS", "ONCA", "SCC", "FCA", "BCSC"]


def cited_rows(t: Tables) -> DataFrame:
    """``id, text``: a sentence with two case citations and two regulations for every order."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    part = lambda n: (k % n + 1).cast("string")
    court = F.element_at(F.array(*map(F.lit, COURTS)), (k % len(COURTS) + 1).cast("int"))
    said = [
        F.lit("See "), year, F.lit(" "), court, F.lit("  "), part(99999), F.lit(" and ["), year, F.lit("]"), part(3), F.when(k % 2 == 0, " S.C.R. ").otherwise("SCR"), part(9999),
        F.lit("; O. Reg. "), part(900), F.lit("/"), F.substring(year, 3, 2), F.lit(", R.R.O. 1990, Reg. "), part(1100), F.lit("."),
    ]
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(*said).alias("text"))


@query
def neutral_citation_extract(t: Tables) -> DataFrame:
    found = cited_rows(t).select("id", F.posexplode(text.case_citations(F.col("text"))).alias("pos", "raw"))
    return found.select("id", "pos", "raw", text.canonical(F.col("raw")).alias("canonical"))


@query
def regulation_refs_extract(t: Tables) -> DataFrame:
    return cited_rows(t).select("id", F.explode(text.regulation_refs(F.col("text"))).alias("r")).select("id", "r.citation", "r.alias")


@query
def json_section_explode(t: Tables) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.explode(m).alias("section_no", "text"))


@query
def title_expansion(t: Tables) -> DataFrame:
    """Rows of titles and their variants by CASE, unnested and united."""
    p = t.part.select("p_partkey", "p_name", "p_brand")
    long = F.size(F.split("p_name", " ")) >= 2
    variants = F.filter(F.array(F.when(long, F.lower("p_name")), F.regexp_replace("p_brand", "Brand#", "Brand ")), lambda x: x.isNotNull())
    names = p.select("p_partkey", F.col("p_name").alias("title"))
    return names.unionByName(p.select("p_partkey", F.explode(variants).alias("title"))).distinct()


# --- retrieval ---------------------------------------------------------------------------------------------------


@query
def bm25_topk(t: Tables) -> DataFrame:
    return lexical.bm25_topk(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 10)


@query
def bm25_filtered(t: Tables) -> DataFrame:
    """The filter is a semi-join before the top-k; statistics stay corpus-wide."""
    allowed = t.documents.where("lang = 'en'").select("doc_id")
    return lexical.bm25_topk(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 5, allowed)


def _seed_vectors(t: Tables) -> DataFrame:
    """The stated queries: every twentieth vector."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query
def cosine_topk(t: Tables) -> DataFrame:
    return vector.cosine_topk(t.embeddings, _seed_vectors(t), 20)


def _vector_hits(t: Tables, k: int = 50) -> DataFrame:
    """Two lists of each seed vector: nearest by cosine, and nearest on the first eight dimensions."""
    case = t.embeddings.select("vec_id", F.col("label").alias("case_id"))
    full = vector.cosine_topk(t.embeddings, _seed_vectors(t), k).withColumn("source", F.lit("vector"))
    part = t.embeddings.withColumn("embedding", F.slice("embedding", 1, 8))
    few = vector.cosine_topk(part, _seed_vectors(t).withColumn("query", F.slice("query", 1, 8)), k).withColumn("source", F.lit("lexical"))
    both = full.unionByName(few).select("query_id", "source", "rank", F.col("item_id").alias("chunk_id"))
    return both.join(case.withColumnRenamed("vec_id", "chunk_id"), "chunk_id")


@query
def rrf_fuse(t: Tables) -> DataFrame:
    return ranking.fuse(_vector_hits(t)).select("query_id", "case_id", F.round("score", 9).alias("score"), "lexical_rank", "vector_rank", "position")


@query
def best_passages(t: Tables) -> DataFrame:
    out = ranking.passages(_vector_hits(t))
    return out.select("query_id", "case_id", "chunk_id", F.array_join("matched_by", ",").alias("matched_by"), "best_rank", "passage_no")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _order_seeds(t: Tables) -> DataFrame:
    """Seeds: the 30 dearest orders of each priority, one priority a query."""
    order = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice").withColumn("seed_rank", F.row_number().over(order))
    return o.where(F.col("seed_rank") <= ranking.SEEDS).select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderkey").alias("src"), "seed_rank")


def _supplier_edges(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))


@query
def seed_support(t: Tables) -> DataFrame:
    out = ranking.seed_support(_order_seeds(t), _supplier_edges(t))
    return out.withColumn("support", F.round("support", 9))


@query
def graph_expand(t: Tables) -> DataFrame:
    """A base list of suppliers per priority, expanded through what the seeds cite."""
    seeds = _order_seeds(t)
    graph_hits = ranking.seed_support(seeds.where(F.col("seed_rank") <= ranking.SEED_CASES), _supplier_edges(t)).select("query_id", F.col("dst").alias("case_id"), "n_seeds", "graph_rank")
    base = seeds.where("seed_rank <= 10").select("query_id", F.col("seed_rank").cast("long").alias("case_id"), F.round(1.0 / (ranking.RRF_K + F.col("seed_rank")), 12).alias("score"))
    both = base.join(graph_hits, ["query_id", "case_id"], "full_outer")
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce(1.0 / (ranking.RRF_K + F.col("graph_rank")), F.lit(0.0))
    return both.select("query_id", "case_id", F.round(score, 9).alias("score"), "n_seeds", "graph_rank")


@query
def authority_prior(t: Tables) -> DataFrame:
    degree = graph.in_degree(t.lineitem, t.part, "p_partkey", "l_partkey", "l_orderkey")
    court = F.element_at(F.array(*[F.lit(c) for c in ("SCC", "FCA", "FC", "ONCA")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return degree.select("p_partkey", F.round(ranking.authority_prior(court, F.col("cited_by_count")), 9).alias("prior"))


@query
def rerank_blend(t: Tables) -> DataFrame:
    """Head and tail of a long list, with a stand-in scorer that leaves some of the head unscored."""
    hits = vector.cosine_topk(t.embeddings, _seed_vectors(t), 60).select("query_id", F.col("item_id").alias("case_id"), F.round(1.0 / (ranking.RRF_K + F.col("rank")), 12).alias("score"))
    scores = hits.where("case_id % 3 != 0").select("query_id", "case_id", (F.col("case_id") * 37 % 101).cast("double").alias("rerank_score"))
    out = ranking.rerank_blend(hits, scores)
    return out.select("query_id", "case_id", F.round("score", 9).alias("score"), "is_tail", "rerank_rank", "final_rank")


@query
def section_rank(t: Tables) -> DataFrame:
    keys = ["p_brand", "p_size"]
    part = t.part.select("p_partkey", "p_brand", "p_size")
    edges = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), *keys)
    counts = edges.groupBy(*keys).agg(F.countDistinct("src").alias("cited_by_count"))
    lists = []
    for source, by in (("lexical", F.desc("p_retailprice")), ("vector", F.col("p_name").asc())):
        dealt = t.part.withColumn("query_id", F.explode(F.array(*[F.lit(q) for q in PRIORITIES])))
        order = Window.partitionBy("query_id").orderBy(by, "p_partkey")
        lists.append(dealt.withColumn("rank", F.row_number().over(order)).where("rank <= 50").select("query_id", F.lit(source).alias("source"), "rank", *keys))
    seeds = _order_seeds(t).where("seed_rank <= 20")
    out = ranking.rank_sections(lists[0].unionByName(lists[1]), seeds, edges, counts, keys)
    return out.select("query_id", *keys, F.round("score", 9).alias("score"), "n_seeds", "graph_rank", "section_rank").where("section_rank <= 40")


def _issue_lists(t: Tables) -> DataFrame:
    """Lists per group of conversations: rank is the turn, items are hashed roles and text lengths."""
    c = t.conversations.where("text is not null")
    item = F.length("text") % 17
    first = c.select((F.col("conv_id") / 5).cast("long").alias("grp"), (F.col("conv_id") % 5).cast("int").alias("list_no"), (F.col("turn") + 1).alias("rank"), item.alias("item"))
    return first


@query
def interleave(t: Tables) -> DataFrame:
    return ranking.interleave(_issue_lists(t), 10, ["grp"]).select("grp", "item", "position")


@query
def merge_issues(t: Tables) -> DataFrame:
    return ranking.merge_issues(_issue_lists(t), 8, 3, ["grp"]).select("grp", "item", "position")


@query
def merge_group(t: Tables) -> DataFrame:
    lists = _issue_lists(t)
    lists = lists.groupBy("grp", "list_no", "item").agg(F.min("rank").alias("rank"))
    return ranking.number_first_seen(ranking.group_issues(lists, 8, 3, 3, ["grp"]), ["grp"]).select("grp", "group_no", "item", "position", "number", "is_pointer")


@query
def cocitation_pool(t: Tables) -> DataFrame:
    seeds = _order_seeds(t).where("seed_rank <= 8")
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("candidate"), F.year("l_shipdate").alias("year"))
    cited = seeds.join(edges, "src").select("query_id", F.col("src").alias("seed"), (F.col("seed_rank") - 1).alias("seed_index"), "candidate", "year")
    degrees = t.lineitem.groupBy(F.col("l_orderkey").alias("seed")).agg(F.countDistinct("l_suppkey").alias("degree"))
    return graph.cocitation_pool(cited, degrees)


@query
def citing_threshold(t: Tables) -> DataFrame:
    cited = _order_seeds(t).join(_supplier_edges(t), "src").select("query_id", "src", "dst")
    return graph.citing_threshold(cited, 2)


@query
def regulation_citing_counts(t: Tables) -> DataFrame:
    """Distinct regulations of each order's sentence, counted over orders, at least two."""
    cited = cited_rows(t).select("id", F.explode(text.regulation_refs(F.col("text"))).alias("r")).select("id", "r.citation")
    return cited.groupBy("citation").agg(F.countDistinct("id").alias("n")).where("n >= 2")


# --- whole searches ----------------------------------------------------------------------------------------------


def _corpus(t: Tables) -> dict[str, DataFrame]:
    """Documents as chunks, four a case, with the vectors of the same number; orders cite parts as cases cite cases."""
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 4").alias("case_id"), "text").join(vectors, "chunk_id", "left")
    edges = t.lineitem.select((F.col("l_orderkey") % 997).alias("src"), (F.col("l_partkey") % 997).alias("dst"))
    cases = t.documents.select(F.expr("doc_id div 4").alias("case_id")).distinct()
    cited = edges.groupBy("dst").agg(F.countDistinct("src").alias("n"))
    court = F.element_at(F.array(*[F.lit(c) for c in ("SCC", "FCA", "FC", "ONCA")]), (F.col("case_id") % 4 + 1).cast("int"))
    meta = cases.join(cited, F.col("case_id") == F.col("dst"), "left").select("case_id", court.alias("court"), F.coalesce("n", F.lit(0)).alias("cited_by_count"))
    return {"chunks": chunks, "edges": edges, "meta": meta}


def _asked(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id", "left")


def stand_in_scorer(pairs: DataFrame) -> DataFrame:
    """A made-up score of a pair in place of a cross-encoder's."""
    return pairs.select("query_id", "case_id", ((F.col("chunk_id") * 37 + F.col("case_id") * 11) % 101 - 50).cast("double").alias("rerank_score"))


def _found(out: DataFrame) -> DataFrame:
    return out.select("query_id", "case_id", F.round("score", 9).alias("score"), "rerank_score", "final_rank")


@query
def search_hybrid(t: Tables) -> DataFrame:
    return _found(search.search(queries=_asked(t), k=20, scorer=stand_in_scorer, **_corpus(t)))


@query
def search_lexical(t: Tables) -> DataFrame:
    """One list with priors only, and only of cases that a filter lets through."""
    corpus = _corpus(t)
    allowed = corpus["meta"].where("court in ('SCC', 'FC')")
    return _found(search.search(queries=_asked(t), k=10, mode="lexical", allowed=allowed, **corpus)).drop("rerank_score")


@query
def scenario_groups(t: Tables) -> DataFrame:
    """Every four passages are a scenario: the first leads, the others are its issues, gated by the scorer."""
    asked = _asked(t).select(F.struct(F.expr("query_id div 4").alias("scenario_id"), (F.col("query_id") % 4).cast("int").alias("list_no")).alias("query_id"), "text", "vector")
    groups = search.search_scenario(queries=asked, scorer=stand_in_scorer, k=10, lead=search.COMBINED_LEAD, **_corpus(t))
    return groups.select("scenario_id", "group_no", "item", "position", "number", "is_pointer")


@query
def section_pool(t: Tables) -> DataFrame:
    lists = _vector_hits(t).select("query_id", "source", "rank", F.col("chunk_id").alias("item"))
    support = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n_seeds"), F.min("vec_id").alias("item"))
    asked = _seed_vectors(t).select("query_id", (F.col("query_id") % 7).alias("_k"))
    dealt = support.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(6)))).join(asked, "_k").select("query_id", "item", "n_seeds")
    return search.section_pool(lists, dealt, 10)


@query
def section_scope(t: Tables) -> DataFrame:
    """Parts as laws: their maker is the jurisdiction, their type the kind, their brand the code."""
    laws_of = t.part.select("p_partkey", F.substring("p_name", 1, 1).alias("jurisdiction"), F.when(F.col("p_size") == 7, "constitution").otherwise("act").alias("kind"), F.col("p_brand").alias("code"))
    return search.section_scope(laws_of, ["a", "b"], ["Brand#12", "Brand#34"]).select("p_partkey", "kind", "code")


@query
def supported_sections(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("scenario_id"), (F.col("l_linenumber") - 1).alias("list_no"), F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 10).alias("code"), F.col("l_partkey").alias("section_no"),
        (F.col("l_partkey") % 3).alias("cited_by_count"), F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("n_seeds"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity") - 20).alias("rerank_score"),
    )
    named = t.orders.select(F.col("o_orderkey").alias("scenario_id"), (F.col("o_custkey") % 10).alias("code"))
    return search.supported_sections(lines, named).select("scenario_id", "list_no", "code", "section_no")


@query
def uncovered_regulations(t: Tables) -> DataFrame:
    """Regulations of the orders' sentences but those that are a law already."""
    cited = cited_rows(t).select(F.col("id").alias("case_id"), F.explode(text.regulation_refs(F.col("text"))).alias("r")).select("case_id", "r.citation")
    held = t.part.select(F.concat(F.lit("O. Reg. "), F.col("p_partkey").cast("string"), F.lit("/95")).alias("code"))
    return search.uncovered_regulations(cited, held)


@query
def related_cases(t: Tables) -> DataFrame:
    """Nearest vectors without the query's own: k + 1 are asked and k stay."""
    near = vector.cosine_topk(t.embeddings, _seed_vectors(t), 6).select("query_id", F.col("item_id").alias("case_id"), F.col("rank").alias("final_rank"))
    return search.related(near, _seed_vectors(t).select("query_id", F.col("query_id").alias("case_id")), 5).select("query_id", "case_id", "rank")


@query
def issue_labels(t: Tables) -> DataFrame:
    lists = _issue_lists(t).groupBy("grp", "list_no", "item").agg(F.min("rank").alias("rank"))
    groups = ranking.group_issues(lists, 8, 3, 3, ["grp"]).withColumnRenamed("grp", "scenario_id")
    return search.issue_labels(groups).select("scenario_id", "item", F.array_join(F.transform("issues", lambda x: x.cast("string")), ",").alias("issues"))


@query
def unique_seeds(t: Tables) -> DataFrame:
    groups = _issue_lists(t).select(F.col("grp").alias("query_id"), F.col("list_no").alias("group_no"), F.col("rank").alias("position"), F.col("item").alias("seed"))
    return citator.unique_seeds(groups)


@query
def candidate_links(t: Tables) -> DataFrame:
    """Suppliers as candidates of databases (nations, regions their jurisdictions), some of databases nobody knows."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("database_id"), F.lower("r_name").alias("jurisdiction"), F.col("n_name").alias("name"))
    mine = citator.candidate_databases(places, "asia", ("china",)).select("database_id", "jurisdiction", "name")
    named = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("database_id"))
    candidates = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("int").alias("s_nationkey")).join(named, "s_nationkey")
    rows = candidates.select("database_id", F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("case_id"), (F.col("s_suppkey") % 30 + 1990).alias("year"))
    return citator.named_candidates(rows, mine).select("database_id", "case_id", "court_name", "url")


@query
def candidate_metadata(t: Tables) -> DataFrame:
    """Metadata laid over what a candidate list knew, with what a scorer reads."""
    known = t.customer.select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title"), F.lit("old").alias("citation"), F.lit("link").alias("url"))
    meta = t.orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_orderkey").alias("k")).where("k % 2 = 0").select(
        "case_id", F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("title "), F.col("k").cast("string"))).alias("title"), F.col("k").cast("string").alias("citation"), F.lit(None).cast("string").alias("url"),
        F.when(F.col("k") % 4 == 0, "long link").alias("long_url"), F.when(F.col("k") % 5 > 0, "words").alias("keywords"), F.lit("").alias("topics"), F.when(F.col("k") % 7 > 0, "2001-02-03").otherwise("2001-02-99").alias("decision_date"),
    )
    out = citator.with_metadata(known, meta, ["case_id"])
    return out.select("case_id", "title", "citation", "url", "decision_date", citator.describe(F.col("title"), F.col("topics"), F.col("keywords")).alias("described"))


@query
def cited_authorities(t: Tables) -> DataFrame:
    cited = _order_seeds(t).join(_supplier_edges(t), "src").withColumn("title", F.concat(F.lit("t"), (F.col("dst") % 7).cast("string")))
    resolved = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("dst"), F.col("s_suppkey").alias("corpus_id"))
    exclude = resolved.select(F.explode(F.array(*[F.lit(q) for q in PRIORITIES])).alias("query_id"), "corpus_id").where("corpus_id % 2 = 0")
    return citator.cited_authorities(cited, resolved, exclude, 15)


@query
def corpus_citations(t: Tables) -> DataFrame:
    """Names a citator entry may have in the corpus, from entries made of each order."""
    k = F.col("o_orderkey").cast("string")
    entry = F.concat(F.year("o_orderdate").cast("string"), F.lit(" CanLII "), k, F.lit(" (ON CA), 2003 ONCA "), k, F.lit(", [1999] 2 SCR "), k)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.array_join(citator.corpus_citations(entry), "; ").alias("citations"), citator.name_year(F.when(F.col("o_orderkey") % 2 == 0, "onca").otherwise("onsc"), entry).alias("year"))


@query
def case_statutes(t: Tables) -> DataFrame:
    """The lines of every twentieth order: one of each part's brand, the lowest line, most cited brand first."""
    counts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("n"))
    mine = t.lineitem.where("l_orderkey % 20 = 0").join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "p_brand").agg(F.min("l_linenumber").alias("line"))
    return mine.join(counts, "p_brand").select("l_orderkey", "p_brand", "line", "n")


@query
def summaries_of_cases(t: Tables) -> DataFrame:
    """Two tables on a composite key, a source resolved by two columns, and what is left when it doesn't."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))
    last = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_event"), F.max("value").alias("v")).where("v > 50")
    return first.join(last, ["user_id", "event_type"], "left").select("user_id", "event_type", "first_event", F.col("last_event").isNotNull().alias("loaded"))


@query
def nearest_chunk_per_case(t: Tables) -> DataFrame:
    """Of every case (label) the chunk nearest to each query, as DISTINCT ON by distance."""
    chunks = t.embeddings.withColumnRenamed("label", "case_id")
    found = vector.nearest_of_group(chunks, _seed_vectors(t), "case_id")
    return found.select("query_id", "case_id", F.col("item_id").alias("chunk_id"), "dist")


@query
def law_kinds(t: Tables) -> DataFrame:
    """Laws (parts) by kind: how many, their lines and characters; only of makers that a user hasn't excluded."""
    rows = search.optional(t.part, p_size=(5, None), p_retailprice=(None, None), p_name=None)
    kept = rows.where(~F.col("p_brand").isin("Brand#11", "Brand#55"))
    return kept.groupBy("p_type").agg(F.count(F.lit(1)).alias("laws"), F.sum(F.length("p_name")).alias("chars"), F.count(F.when(F.col("p_name").rlike("[aeiou]{2}"), 1)).alias("with_pair"))


@query
def key_terms(t: Tables) -> DataFrame:
    """What must be found of an authority, from authorities made of each part."""
    k = F.col("p_partkey").cast("string")
    authority = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Roe v. Doe, 2001 SCC "), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("ss. 12(1) and 14 of the "), F.initcap("p_name"), F.lit(" Act, s. "), k)).otherwise("abc")
    return t.part.select("p_partkey", F.array_join(text.key_terms(authority), "|").alias("terms"))


@query
def leaked_words(t: Tables) -> DataFrame:
    """Words of a decision's name that a scenario tells, for every part: its name and a sentence with its last word."""
    said = F.concat(F.lit("The tenant of "), F.element_at(F.split("p_name", " "), -1), F.lit(" left the board."))
    return t.part.select("p_partkey", F.array_join(text.leaks(said, F.concat("p_name", F.lit(" Board"))), ",").alias("leaked"))


@query
def merge_strategies(t: Tables) -> DataFrame:
    """Two ways of merging the same lists, scored against the same gold."""
    lists = _issue_lists(t).groupBy("grp", "list_no", "item").agg(F.min("rank").alias("rank")).withColumnRenamed("grp", "scenario_id")
    gold = lists.where("item % 5 = 0").select(F.col("scenario_id").alias("query_id"), "item", F.lit(1).alias("gain")).distinct()
    out = evaluation.compare_merges(lists, gold, {"lead3": (8, 3), "lead0": (8, 0)})
    return out.select("strategy", "query_id", "n_gold", "recall_5", "mrr")


@query
def statute_gold(t: Tables) -> DataFrame:
    """The parts of each customer's orders that are named at least twice, the three most frequent brands."""
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    refs = lines.select(F.col("o_custkey").alias("doc_id"), F.col("p_brand").alias("code"), (F.col("p_size") % 2).alias("section_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start"))
    return evaluation.most_cited_pairs(refs)


# --- evaluation --------------------------------------------------------------------------------------------------


@query
def ndcg_recall_mrr(t: Tables) -> DataFrame:
    """BM25 lists of the benchmark scored against the documents that hold the passage, in two grades."""
    hits = lexical.bm25_topk(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 10).select("query_id", F.col("doc_id").alias("item"), "rank")
    gold = evaluation.containing(t.documents, t.benchmark).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("gain"))
    return evaluation.score_lists(hits, gold).drop("recall_50")


@query
def mean_metrics_by_group(t: Tables) -> DataFrame:
    """Means of a metric by split, nulls left out."""
    return t.labels.groupBy((F.col("doc_id") % 2).alias("split")).agg(F.round(F.avg("quality"), 9).alias("quality"), F.round(F.avg("toxic"), 9).alias("toxic"), F.count(F.lit(1)).alias("n"))


@query
def config_grid(t: Tables) -> DataFrame:
    """Every configuration on the same lists, in one job; the smallest near-best weights win."""
    grid = evaluation.grid(t.spark, {"graph": [0.0, 0.5, 1.0], "prior": [0.0, 0.002], "rerank": [0.0, 1.0]})
    rows = t.part.select(
        (F.col("p_size") % 5).alias("query_id"), F.col("p_partkey").alias("item"), (1.0 / (60 + F.col("p_size"))).alias("base"), (F.col("p_partkey") % 7 == 0).alias("gold"),
        (F.col("p_partkey") % 11 / 1000).alias("graph"), (F.col("p_partkey") % 3).cast("double").alias("prior"), ((F.col("p_partkey") % 7 == 0).cast("int") / 100).alias("rerank"),
    )
    return evaluation.tune(rows, grid, ["graph", "prior", "rerank"])


# --- sequential text logic: rows only ----------------------------------------------------------------------------


@query
def chunk_windows(t: Tables) -> DataFrame:
    return chunking.chunks(t.documents).select("doc_id", "chunk_no", "para_no", "para_end", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


LAWS = [
    ("Income Tax Act", "I-3.3", "act", "federal"),
    ("Income Tax Act", "RSO1990cI2", "act", "ontario"),
    ("Immigration and Refugee Protection Act", "I-2.5", "act", "federal"),
    ("Constitution Act, 1982", "CONST-1982", "constitution", "federal"),
]


@query
def section_references(t: Tables) -> DataFrame:
    """References of all documents and of a statement about every order, in four forms."""
    k = F.col("o_orderkey")
    a, b = (k % 200 + 1).cast("string"), (k % 9 + 1).cast("string")
    forms = [
        F.concat(F.lit("Under section "), a, F.lit("("), b, F.lit(") of the Income Tax Act, the claim fails.")),
        F.concat(F.lit("See Immigration and Refugee Protection Act, S.C. 2001, c. 27, s. "), a, F.lit(".")),
        F.concat(F.lit("The Income Tax Act governs. Subsection "), a, F.lit("("), b, F.lit(") of the Act is plain.")),
        F.concat(F.lit("For the province: Income Tax Act, R.S.O. 1990, c. I.2, s. "), a, F.lit(".")),
    ]
    said = t.orders.select(k.alias("doc_id"), F.element_at(F.array(*forms), (k % 4 + 1).cast("int")).alias("text"))
    both = t.documents.select((-1 - F.col("doc_id")).alias("doc_id"), "text").unionByName(said)
    return laws.section_references(both, laws.LawIndex.from_rows(LAWS)).select("doc_id", "code", "section_no", "pinpoint", "start", "confidence")


@query
def name_lookup(t: Tables) -> DataFrame:
    """Parts looked up by key, name or keywords; asked are the names of all parts whose key is divisible by 20."""
    cases = t.part.select(
        F.col("p_partkey").alias("case_id"), F.concat(F.lit("2001 SCC "), F.col("p_partkey").cast("string")).alias("citation"),
        F.lit(None).cast("string").alias("citation2"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_size").alias("cited_by_count"),
    )
    asked = t.part.where("p_partkey % 20 = 0").select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("text"))
    more = t.spark.createDataFrame([("c", "2001  CSC 7"), ("k", "zzz steel")], "query_id string, text string")
    return lookup.lookup(cases, asked.unionByName(more))


@query
def brief_verify(t: Tables) -> DataFrame:
    """Every document's first words as an item on its first passage and its source as a party."""
    chunks = chunking.chunks(t.documents)
    items = t.documents.where("text is not null").select("doc_id", F.lit("issues").alias("section"), F.lit(0).alias("idx"), F.lit(1).alias("anchor"), F.substring("text", 1, 120).alias("text"))
    names = t.documents.select("doc_id", F.lit("party").alias("kind"), F.lit(0).alias("idx"), F.col("source").alias("name"))
    out = briefs.summary(briefs.verify_items(items, briefs.anchors(chunks)), briefs.names_in_text(names, t.documents))
    return out.select("doc_id", "problems", "words", "too_long", F.size("warnings").alias("n_warnings"))


__all__ = ["ORACLES", "QUERIES"]
