"""Citation edges: resolution against a dimension, counts, co-citation and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the citing-case pool.
DECAY, POOL = 0.1, 12


def unique_keys(owners: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Keys that exactly one id owns; ambiguous ones are dropped, not chosen from."""
    one = owners.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.min(id_col).alias(id_col), F.max(id_col).alias("_other"))
    return one.where(F.col(id_col) == F.col("_other")).drop("_other")


def resolve(raw: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Edges whose key resolves, without self-citations: ``raw(src, *on)``, ``keys(*on, id)``."""
    return raw.join(keys, on).where(F.col("src") != F.col("id")).select("src", F.col("id").alias("dst"), *on)


def resolve_with_year_before(raw: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Named keys by year, falling back to the year before: ``raw(src, *names, year)``, ``keys(*names, year, id)``."""
    exact = keys.select(*names, "year", F.col("id").alias("_exact"))
    before = keys.select(*names, (F.col("year") + 1).alias("year"), F.col("id").alias("_before"))
    joined = raw.join(exact, [*names, "year"], "left").join(before, [*names, "year"], "left")
    return joined.withColumn("dst", F.coalesce("_exact", "_before")).where("dst is not null and dst != src").drop("_exact", "_before")


def first_wins(edges: DataFrame, priority: list[str]) -> DataFrame:
    """One edge for each (src, dst): that of the first source in ``priority``, then the first position."""
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(priority)], F.lit(len(priority)))
    order = Window.partitionBy("src", "dst").orderBy(rank, "position")
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_confidence(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the highest confidence, the first raw form on ties."""
    order = Window.partitionBy("src", "dst").orderBy(F.desc("confidence"), "position")
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def in_degree(edges: DataFrame, nodes: DataFrame, node: str, dst: str, src: str) -> DataFrame:
    """Distinct citing sources for every node, 0 where none."""
    counts = edges.groupBy(dst).agg(F.countDistinct(src).alias("cited_by_count"))
    return nodes.select(node).join(counts, F.col(node) == F.col(dst), "left").select(node, F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))


def covering_range(refs: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, order: str) -> DataFrame:
    """For each reference the range of its key that covers it, else the key's first: an equi-join, no range join."""
    joined = refs.join(ranges, keys)
    covers = F.coalesce((F.col(low) <= F.col(at)) & (F.col(at) <= F.col(high)), F.lit(False))
    best = Window.partitionBy("ref_id").orderBy(F.desc("covers"), order)
    return joined.withColumn("covers", covers).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def cocitation_pool(cited: DataFrame, degrees: DataFrame, size: int = POOL, digits: int = 9) -> DataFrame:
    """Candidates pooled over seeds by 1/(1+0.1*index)/sqrt(degree of the seed).

    ``cited(query_id, seed, seed_index, candidate, year)``: index counts the seeds that returned a list, from 0;
    ``degrees(seed, degree)``.  A candidate counts once a seed.
    """
    once = cited.groupBy("query_id", "seed", "seed_index", "candidate").agg(F.max("year").alias("year"))
    weight = 1.0 / (1 + DECAY * F.col("seed_index")) / F.sqrt(F.col("degree"))
    pooled = once.join(degrees, "seed").groupBy("query_id", "candidate").agg(F.round(F.sum(weight), digits).alias("score"), F.count(F.lit(1)).alias("n_cites"), F.max("year").alias("year"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("n_cites"), F.desc("year"), "candidate")
    return pooled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def citing_threshold(cited: DataFrame, least: int = 2) -> DataFrame:
    """Targets cited by at least ``least`` distinct seeds, self-citations left out: ``query_id, dst, n``."""
    seeds = cited.where(F.col("src") != F.col("dst")).groupBy("query_id", "dst").agg(F.countDistinct("src").alias("n"))
    return seeds.where(F.col("n") >= least)


def either_key(left: DataFrame, right: DataFrame, key: str, options: list[str], row_id: str) -> DataFrame:
    """Rows of ``right`` that match ``key`` on any of ``options``: a union of equi-joins, each row once."""
    parts = [right.join(left.select(F.col(key).alias(o)).distinct(), o, "left_semi") for o in options]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out.dropDuplicates([row_id])
