"""Intermediate tables in the shared folder: a result that several branches read is computed once and cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one serves only where all run on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "citeloom-checkpoints")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again; it survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/citeloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of long texts that pass to Python at a time.
FEW = "512"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Few rows an Arrow batch for what is run inside, so that a batch of whole texts stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, FEW)
    try:
        yield
    finally:
        spark.conf.set(name, before)
