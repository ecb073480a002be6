"""Sinks: partitioned writes, rebuilds, upserts and insert-if-absent on keyed Parquet tables, a run log."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def rebuild(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``df`` has and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def union_missing(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; of repeated new rows the last by ``updated_at`` stays."""
    order = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("updated_at"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` lacks, one for each key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def set_counts(nodes: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``nodes`` with ``cited_by_count`` set from ``counts``, 0 where it has none."""
    return nodes.drop("cited_by_count").join(counts.select(key, "cited_by_count"), key, "left").withColumn("cited_by_count", F.coalesce("cited_by_count", F.lit(0)))


def swap(df: DataFrame, path: str) -> str:
    """Writes a new version beside ``path`` and returns its folder: readers of the old one are not disturbed."""
    to = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return to


def log_run(spark: SparkSession, path: str, job: str, status: str, cursor: str | None = None) -> None:
    """Append-only run log; a job's state is its latest row."""
    row = spark.createDataFrame([(job, status, cursor)], "job string, status string, cursor string")
    append(row.withColumn("at", F.current_timestamp()), path)


def job_states(log: DataFrame) -> DataFrame:
    order = Window.partitionBy("job").orderBy(F.desc("at"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def put_objects(files: DataFrame, path: str) -> DataFrame:
    """Stores contents under their hash, each once, and returns ``content_hash`` of what is new: ``files(content)``."""
    spark = files.sparkSession
    rows = files.select(F.sha2("content", 256).alias("content_hash"), "content").dropDuplicates(["content_hash"])
    try:
        known = objects(spark, path)
    except AnalysisException:
        known = spark.createDataFrame([], rows.schema)
    new = insert_absent(known, rows, ["content_hash"])
    to = f"{path}/part-{uuid.uuid4().hex}"
    new.write.parquet(to)
    return spark.read.parquet(to).select("content_hash")


def objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def json_report(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields included."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def cached(found: DataFrame, path: str, keys: list[str], as_of: str, days: int) -> DataFrame:
    """Rows of a cache at ``path`` that are at most ``days`` old at ``as_of``, the latest of each key; ``found`` fills the rest."""
    try:
        kept = found.sparkSession.read.parquet(path)
    except AnalysisException:
        return found
    fresh = kept.where(F.col("fetched_at") > F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days)))
    order = Window.partitionBy(*keys).orderBy(F.desc("fetched_at"))
    latest = fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return latest.unionByName(found.join(latest.select(*keys), keys, "left_anti"), allowMissingColumns=True)
