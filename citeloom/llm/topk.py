"""Exact top-k inner products over norm-sorted vectors with rotated partial sums.

Vectors stand in bands of falling length.  A rotation by the singular vectors of the candidates puts most of each
product into the first coordinates; the rest is bounded by Cauchy-Schwarz from the two residual lengths.  A candidate
whose partial sum plus this bound can't reach a query's k-th best score so far is dropped, and a block whose longest
vector can't reach any is skipped; those behind it in the band, all shorter, then are too.  Survivors are scored exactly in
whole numbers, so rounding of the rotation only costs a margin, never a result.

The first band is searched first, and its k-th scores start the search of all the others.  Queries pass in blocks of
about QUERY_BLOCK rows, which is what a broadcast holds; candidates are never broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import stored

QUERY_BLOCK = 32_768
BLOCK = 2_048
#: Candidates of the first band, searched before the rest to start the thresholds.
SEED_ROWS = 8_192
#: Tasks that search the first band.
SEED_TASKS = 8
#: Squared length up to which an inner product of two vectors surely fits into a long.
LARGEST = float(1 << 62)
#: Queries multiplied at a time, so that a task holds at most this many times BLOCK partial sums.
TILE = 2_048


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``(vec_id, dim, payload, norm)`` with floor(scale * x) as 64-bit whole numbers; unusable vectors are left out."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, payload, norm, dim = [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(float) * scale)
                if np.isfinite(x).all():
                    if (x * x).sum() > LARGEST:
                        raise ValueError(f"vector {i}: its inner products need not fit into 64 bits")
                    w = x.astype(np.int64)
                    ids.append(i)
                    payload.append(w.tobytes())
                    norm.append(float(np.sqrt((x * x).sum())))
                    dim.append(len(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dim, pa.int32()), pa.array(payload, pa.binary()), pa.array(norm, pa.float64())], names=["vec_id", "dim", "payload", "norm"])

    return rows.mapInArrow(run, "vec_id long, dim int, payload binary, norm double")


def _matrix(payloads: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(payloads), dim), np.int64)
    for i, p in enumerate(payloads):
        w = np.frombuffer(p, np.int64)
        out[i, : len(w)] = w
    return out


def rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and squared singular values of all vectors; what moves is a dim x dim sum a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = _matrix(b.column(0).slice(at, BLOCK).to_pylist(), dim).astype(float)
                gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))], names=["i", "row"])

    parts = vectors.select("payload").mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((dim, dim))
    for r in cells.collect():  # dim * dim numbers
        gram[r["i"], r["j"]] = r["x"]
    values, basis = np.linalg.eigh(gram)
    return basis[:, ::-1], values[::-1]


class Queries:
    """A block of queries, its rotation and the best scores so far."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, basis: np.ndarray, head: int, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.whole, self.basis, self.head, self.k = ids, whole, basis, head, k
        turned = whole.astype(float) @ basis
        self.front = turned[:, :head]
        self.rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        self.norm = np.sqrt((turned**2).sum(axis=1))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.astype(float)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), sorted

    def search(self, ids: np.ndarray, payloads: list[bytes], norms: np.ndarray) -> None:
        """One block of candidates; nothing of it is read if even its longest vector can't matter to any query."""
        longest = norms.max()
        slack = 1e-6 * (1 + self.norm * longest)
        active = np.flatnonzero(self.norm * longest + slack >= self.floor)
        if not len(active):
            return
        whole = _matrix(payloads, self.whole.shape[1])
        turned = whole.astype(float) @ self.basis
        front, rest = turned[:, : self.head], np.sqrt((turned[:, self.head :] ** 2).sum(axis=1))
        for at in range(0, len(active), TILE):
            q = active[at : at + TILE]
            bound = self.front[q] @ front.T + np.outer(self.rest[q], rest)
            alive = bound + slack[q][:, None] >= self.floor[q][:, None]
            for row in np.flatnonzero(alive.any(axis=1)):
                self.score(q[row], np.flatnonzero(alive[row]), bound[row], ids, whole, slack[q[row]])

    def score(self, i: int, at: np.ndarray, bound: np.ndarray, ids: np.ndarray, whole: np.ndarray, slack: float) -> None:
        """Exact scores of the survivors ``at`` of query i, the most promising first."""
        at = at[np.argsort(-bound[at], kind="stable")]
        best = self.best[i]
        step = 16 * self.k
        for x in range(0, len(at), step):
            some = at[x : x + step]
            if bound[some[0]] + slack < self.floor[i]:
                break
            scores = whole[some] @ self.whole[i]
            order = np.lexsort((ids[some], -scores))
            fresh = [(-int(scores[j]), int(ids[some[j]])) for j in order if ids[some[j]] != self.ids[i] and scores[j] >= self.floor[i]]
            if fresh:
                best[:] = sorted(best + fresh)[: self.k]
                if len(best) == self.k:
                    self.floor[i] = max(self.floor[i], -best[-1][0])

    def rows(self) -> pa.RecordBatch:
        q = [int(self.ids[i]) for i, b in enumerate(self.best) for _ in b]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([x[1] for b in self.best for x in b], pa.int64()), pa.array([-x[0] for b in self.best for x in b], pa.int64())], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score long"


def top_products(
    table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, energy: float = 0.6
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best inner products over the whole of ``table``.

    A query is never its own result; ties go to the smaller id.  ``energy``: the part of the squared lengths that the
    partial sums shall cover.

    Defined cases: vectors that are null, empty or hold null, NaN or infinite components take no part on either side;
    shorter vectors count as padded with zeros; fewer than k candidates give fewer rows; equal vectors are all
    candidates; rows that repeat an id are candidates each, so an id may appear twice, and a query id that repeats is asked once, with the least of its vectors (as
    bytes); empty tables give no rows; vectors of a squared length (scaled) over LARGEST
    raise an error, as their scores need not fit into a long.
    """
    spark = table.sparkSession
    vectors = stored(whole_vectors(table, id_col, vector_col, scale), "topk-vectors")
    asked = stored(whole_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min(F.struct("payload", "dim")).alias("q")).select("vec_id", "q.payload", "q.dim"), "topk-queries")
    size = vectors.agg(F.count(F.lit(1)), F.max("dim")).first()
    n_asked, width = asked.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not size[0] or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(size[1], width)
    basis, values = rotation(vectors, dim)
    head = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), energy)) + 1
    head = min(dim, max(1, head))
    banded = stored(vectors.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), "topk-banded").select("vec_id", "payload", "norm")
    longest = banded.orderBy(F.desc("norm"), "vec_id").limit(SEED_ROWS)
    longest = stored(longest.repartition(SEED_TASKS).sortWithinPartitions(F.desc("norm"), "vec_id"), "topk-longest")
    blocks = -(-n_asked // (QUERY_BLOCK // 2)) if n_asked > QUERY_BLOCK else 1
    numbered = asked.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        mine = numbered.where(F.col("_b") == b).select("vec_id", "payload").collect()  # about QUERY_BLOCK / 2 rows
        ids = np.array([r[0] for r in mine], np.int64)
        held = spark.sparkContext.broadcast((ids, _matrix([bytes(r[1]) for r in mine], dim)))

        def run(batches: Iterator[pa.RecordBatch], floor=None, held=held) -> Iterator[pa.RecordBatch]:
            found = Queries(*held.value, basis, head, k, None if floor is None else floor.value)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    found.search(part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(2).to_numpy())
            yield found.rows()

        # At most SEED_TASKS * k scores a query; the k-th best of them is where the search starts.
        scores = F.sort_array(F.collect_list("score"), asc=False)
        first = longest.mapInArrow(run, FOUND).groupBy("query_id").agg(F.try_element_at(scores, F.lit(k)).alias("low")).where("low is not null")
        low = {r["query_id"]: r["low"] for r in first.collect()}  # a row a query of this block
        floor = spark.sparkContext.broadcast(np.array([low.get(int(i), -np.inf) for i in ids], float))
        found = banded.mapInArrow(lambda it, run=run, floor=floor: run(it, floor), FOUND)
        if blocks > 1:
            found = stored(found, "topk-found", narrow=True)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
