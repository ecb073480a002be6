"""Exact cosine nearest neighbours for a batch of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.best import Best, keys, sortable

#: Items and queries that a task multiplies at a time: bounds the matrices it holds, whatever their numbers.
BLOCK, TILE = 2_048, 256
#: Nearest items of (query, group) that a task holds before it sends them on.
HELD = 2_000_000


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """One row a vector, NaN throughout where it is null or has another length, NaN where a component is null."""
    fits = pc.equal(pc.fill_null(pc.list_value_length(rows), -1), width)
    out = np.full((len(rows), width), np.nan)
    held = rows.filter(fits)
    out[fits.to_numpy(zero_copy_only=False)] = held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(held), width)
    return out


def _units(rows: pa.Array, width: int) -> np.ndarray:
    x = _matrix(rows, width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _asked(items: DataFrame, queries: DataFrame, query_limit: int):
    """Blocks of queries as broadcasts ``(ids, unit vectors)``, each of at most about ``query_limit``."""
    n = queries.count()
    blocks = -(-n // query_limit) if n else 1
    numbered = queries.where("query is not null").select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b"))
    for b in range(blocks):
        mine = numbered.where(F.col("_b") == b).toArrow()
        ids, rows = mine["query_id"].combine_chunks(), mine["query"].combine_chunks()
        width = pc.max(pc.list_value_length(rows)).as_py() or 0
        yield items.sparkSession.sparkContext.broadcast((ids, _units(rows, width)))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cosine_topk(items: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_limit: int = 10_000, digits: int = 6) -> DataFrame:
    """``query_id, item_id, dist, rank``: k nearest by 1 - cosine, ties to the smaller id.

    ``queries(query_id, query)`` are a stated set against all items: counted, and in blocks of at most about
    ``query_limit``, which is what a broadcast holds.  A task multiplies its items with the block tile by tile and
    keeps its own k best of each query, so it holds k rows a query and one tile, and k rows a query and task are shuffled.

    Defined cases: vectors that are null, hold a null or NaN, have length 0 or another dimension than the queries are
    no result; queries likewise have none; empty tables give no rows.
    """
    left = items.select(F.col(id_col).alias("item_id"), F.col(vector_col).alias("v")).where("v is not null and item_id is not null")
    kinds = {**dict(queries.dtypes), **dict(left.dtypes)}
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, raw double"
    parts = []
    for held in _asked(items, queries, query_limit):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, unit = held.value
            best = Best(len(unit), k)
            for batch in batches:
                for at in range(0, batch.num_rows if unit.size else 0, BLOCK):
                    part = batch.slice(at, BLOCK)
                    names, order = sortable(part.column(0))
                    x = _units(part.column(1), unit.shape[1])[order].T
                    for q in range(0, len(unit), TILE):
                        best.add(q, 1 - unit[q : q + TILE] @ x, names, digits)
            for q, item, dist in best.rows():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(item, batch.schema.field(0).type), pa.array(dist)], names=["query_id", "item_id", "raw"])

        parts.append(left.mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy("dist", "item_id")
    ranked = _union(parts).select("query_id", "item_id", (F.round("raw", digits) + F.lit(0.0)).alias("dist")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def nearest_of_group(items: DataFrame, queries: DataFrame, group_col: str, id_col: str = "vec_id", vector_col: str = "embedding", query_limit: int = 10_000, digits: int = 6) -> DataFrame:
    """``query_id, <group_col>, item_id, dist``: of every group the item nearest to each query, ties to the smaller id.

    Queries and defined cases as in ``cosine_topk``.  A task keeps one item a query and group and sends them on when they
    are more than ``HELD``; no pair of a query and an item is a row.
    """
    left = items.select(F.col(id_col).alias("item_id"), F.col(group_col).alias("_g"), F.col(vector_col).alias("v")).where("v is not null and item_id is not null")
    kinds = {**dict(queries.dtypes), **dict(left.dtypes)}
    schema = f"query_id {kinds['query_id']}, _g {kinds['_g']}, item_id {kinds['item_id']}, dist double"
    parts = []
    for held in _asked(items, queries, query_limit):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, unit = held.value
            found: dict[object, Best] = {}
            kind = group_kind = None

            def sent() -> Iterator[pa.RecordBatch]:
                for g, best in found.items():
                    for q, item, dist in best.rows():
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array([g] * len(q), group_kind), pa.array(item, kind), pa.array(dist)], names=["query_id", "_g", "item_id", "dist"])
                found.clear()

            for batch in batches:
                kind, group_kind = batch.schema.field(0).type, batch.schema.field(1).type
                for at in range(0, batch.num_rows if unit.size else 0, BLOCK):
                    part = batch.slice(at, BLOCK)
                    names, order = sortable(part.column(0))
                    coded = part.column(1).dictionary_encode(null_encoding="encode")
                    code = coded.indices.to_numpy(zero_copy_only=False)[order]
                    by = np.argsort(code, kind="stable")
                    names, x = names[by], _units(part.column(2), unit.shape[1])[order][by].T
                    starts = np.flatnonzero(np.r_[True, np.diff(code[by]) != 0])
                    groups = [coded.dictionary[int(c)].as_py() for c in code[by][starts]]
                    for q in range(0, len(unit), TILE):
                        key = keys(1 - unit[q : q + TILE] @ x, digits)
                        least = np.minimum.reduceat(key, starts, axis=1)
                        for j, g in enumerate(groups):
                            if g not in found:
                                found[g] = Best(len(unit), 1)
                            found[g].merge(q, least[:, j : j + 1], names, key.shape[1], digits)
                    if len(found) * len(unit) > HELD:
                        yield from sent()
            yield from sent()

        parts.append(left.mapInArrow(run, schema))
    near = _union(parts).groupBy("query_id", "_g").agg(F.min(F.struct("dist", "item_id")).alias("b"))
    return near.select("query_id", F.col("_g").alias(group_col), "b.item_id", "b.dist")
