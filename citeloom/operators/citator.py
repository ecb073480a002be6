"""Cases outside the corpus: seeds, candidates that cite them, authorities that several seeds cite, links and metadata.

The citator's answers are inputs: ``databases(database_id, jurisdiction, name)``, lists of citing and cited cases, and
metadata rows.  Nothing here asks a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.ranking import passes_gate

# Seeds of a search, jurisdiction of candidates, databases that the corpus holds, gate, citations.
MAX_SEEDS, CANDIDATE_JURISDICTION, IN_CORPUS, CANDIDATE_GATE = 8, "on", ("onca",), -4.0
NEUTRAL, SCR, CANLII_YEAR = r"\b([0-9]{4}) ([A-Z]{2,6}) ([0-9]+)\b", r"\[([0-9]{4})\] ([0-9]) SCR ([0-9]+)", r"\b([0-9]{4}) CanLII\b"
LINK = "https://www.canlii.org/en/%s/%s/doc/%s/%s/%s.html"


def unique_seeds(groups: DataFrame, most: int = MAX_SEEDS) -> DataFrame:
    """``query_id, seed, seed_index``: seeds round-robin over the groups, first occurrence only: ``groups(query_id, group_no, position, seed)``."""
    first = groups.where("seed is not null").groupBy("query_id", "seed").agg(F.min(F.struct("position", "group_no")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "seed")
    return first.withColumn("seed_index", F.row_number().over(order) - 1).where(F.col("seed_index") < most).drop("at")


def candidate_databases(databases: DataFrame, jurisdiction: str = CANDIDATE_JURISDICTION, held: tuple[str, ...] = IN_CORPUS) -> DataFrame:
    """Databases whose cases may be candidates: of the jurisdiction and not in the corpus already."""
    return databases.where((F.col("jurisdiction") == jurisdiction) & ~F.col("database_id").isin(*held))


def named_candidates(candidates: DataFrame, databases: DataFrame) -> DataFrame:
    """Candidates with their court's name and a link; an unknown database leaves the name null and links by the default."""
    found = candidates.join(databases.select("database_id", "jurisdiction", F.col("name").alias("court_name")), "database_id", "left")
    place = F.coalesce("jurisdiction", F.lit(CANDIDATE_JURISDICTION))
    link = F.format_string(LINK, place, F.col("database_id"), F.col("year").cast("string"), F.col("case_id"), F.col("case_id"))
    return found.withColumn("url", link).drop("jurisdiction")


def with_metadata(candidates: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Title, citation and link overlaid where metadata has them; keywords, topics and date taken from it alone.

    An empty value counts as missing, and a date that isn't an ISO date is null.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    new = metadata.select(*keys, given("title").alias("_title"), given("citation").alias("_citation"), F.coalesce(given("url"), given("long_url")).alias("_url"), given("keywords").alias("keywords"), given("topics").alias("topics"), tolerant_date(F.col("decision_date")).alias("decision_date"))
    joined = candidates.join(new, keys, "left")
    for c in ("title", "citation", "url"):
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return joined


def tolerant_date(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def describe(title: Column, topics: Column, keywords: Column) -> Column:
    """What a scorer reads: title, topics and keywords, what is missing left out."""
    return F.concat_ws(". ", *[F.nullif(c, F.lit("")) for c in (title, topics, keywords)])


def best_candidates(scored: DataFrame, k: int, floor: float = CANDIDATE_GATE) -> DataFrame:
    """The k best scores at or above the gate: ``scored(query_id, candidate, rank, rerank_score)``, ties by pool rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.where(passes_gate(F.col("rerank_score"), floor, inclusive=True)).withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


def corpus_citations(citation: Column) -> Column:
    """Corpus citations that a citator entry may be stored under: neutral ones but CanLII's own, then SCR."""
    parts = lambda p: F.arrays_zip(*[F.regexp_extract_all(citation, F.lit(p), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)])
    neutral = F.transform(F.filter(parts(NEUTRAL), lambda z: z["g2"] != "CanLII"), lambda z: F.concat_ws(" ", z["g1"], z["g2"], z["g3"]))
    return F.concat(neutral, F.transform(parts(SCR), lambda z: F.concat(F.lit("["), z["g1"], F.lit("] "), z["g2"], F.lit(" SCR "), z["g3"])))


def name_year(database: Column, citation: Column) -> Column:
    """Year under which a Court of Appeal decision without neutral citation is known by its parties; else null."""
    return F.when(database == "onca", F.nullif(F.regexp_extract(citation, CANLII_YEAR, 1), F.lit("")).cast("int"))


def cited_authorities(cited: DataFrame, resolved: DataFrame, exclude: DataFrame, k: int, least: int = 2) -> DataFrame:
    """``query_id, dst, n, corpus_id, rank``: authorities that at least ``least`` seeds cite.

    ``cited(query_id, src, dst, title)``, ``resolved(dst, corpus_id)``, ``exclude(query_id, corpus_id)``.  A seed citing
    itself doesn't count; what resolves to an excluded case goes, what doesn't resolve stays.  Most cited first, those
    outside the corpus before those in it, then by title and id.
    """
    counted = cited.where("src != dst").groupBy("query_id", "dst").agg(F.countDistinct("src").alias("n"), F.min("title").alias("title")).where(F.col("n") >= least)
    known = counted.join(resolved, "dst", "left").join(exclude.select("query_id", "corpus_id"), ["query_id", "corpus_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), F.col("corpus_id").isNotNull(), F.coalesce("title", F.lit("")), "dst")
    return known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "dst", "n", "corpus_id", "rank")
