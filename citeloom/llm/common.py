"""Helpers that the training-data operators share.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``; a local folder is taken only
where that setting is absent (tests on one machine).  Rows are never collected: what reaches the driver is a count
or a table whose size has a stated bound.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators know it: space and the controls tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"

#: A side of at most this many narrow rows (some tens of MB) may be broadcast; it is counted first.
BROADCAST_ROWS = 200_000
#: Rows of one key that a task of ``spread_join`` may hold.
KEY_ROWS = 4_096


def long_texts(spark: SparkSession) -> SparkSession:
    """Session settings for tables of long texts: few rows a batch, so that a batch of whole texts stays small."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local folder serves only where all run on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "citeloom-checkpoints")


def stored(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors.

    ``narrow``: rows of a few numbers from a cheap step; a file then takes 16 shuffle partitions, in proportion to
    their number, instead of one.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(12, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = f"{shared_dir(spark).rstrip('/')}/citeloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._citeloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and nothing will read again."""
    path = getattr(df, "_citeloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    salt_by: Column | None = None,
    right_rows: int | None = None,
    salts: int = 8,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table with one that is unique on ``keys``, safe when one key holds a third of ``left``.

    ``right`` is counted: up to ``broadcast_rows`` rows it is broadcast (no shuffle of ``left`` at all).  Beyond that
    ``left`` is spread over ``salts`` sub-keys by ``salt_by`` and ``right`` is repeated once for each of them.  The
    columns of ``left`` may have any names.
    """
    rows = right.count() if right_rows is None else right_rows
    if rows <= broadcast_rows:
        return left.join(F.broadcast(right), keys, how)
    if salt_by is None:
        return left.join(right, keys, how)
    salt = unused("_salt", [*left.columns, *right.columns])
    spread = left.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, salt], how).drop(salt)


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (Spark's names ignore case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def spread_join(left: DataFrame, right: DataFrame, key: str, salt_by: Column, key_rows: int = KEY_ROWS) -> DataFrame:
    """Inner join of narrow rows with wide ones on a key that may be hot in ``left`` and is not in ``right``.

    Keys with more than ``key_rows`` rows in ``left`` are dealt over as many sub-keys as that takes, and only their
    rows of ``right`` are repeated, so splits grow with the key and nothing else is copied.
    """
    heavy = left.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > key_rows).select(key, F.ceil(F.col("rows") / key_rows).cast("int").alias("parts"))
    heavy = stored(heavy, "heavy-keys", narrow=True)
    count = heavy.count()
    if not count:
        dropped(heavy)
        return left.join(right, key)
    if count <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    dealt = left.join(heavy, key, "left").withColumn("part", F.pmod(F.xxhash64(salt_by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = right.join(heavy, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [key, "part"]).drop("part")
