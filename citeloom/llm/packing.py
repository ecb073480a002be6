"""Best-fit packing of documents into token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of at most ``capacity`` counts says all that packing
needs; the plan is made on the driver from it alone and costs the same for a thousand or 10**10 documents:

1. Large lengths, in falling order, are cut into groups of equal cardinality; each is rounded up to its group's
   largest, which leaves few sizes.
2. A configuration is a multiset of these sizes that fits one sequence.  A linear programme over configurations
   (column generation with a knapsack) says how often to use each; the counts are rounded down.
3. Actual documents take the slots of their group, so the room that rounding held is free again.
4. What is left, the large remainder and all small documents, goes best-fit, longest first, into the fullest
   sequence that has room.

Sequences with equal contents are kept as runs, and the plan names, for each length, ranges of ranks.  The documents
get their rank within a length from a window over (length, salt), and one broadcast join with the plan, whose number
of rows has a bound in the capacity, gives each its sequence and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import stored
from citeloom.llm.tokens import ByteBpe

CAPACITY = 2048
#: Lengths above this part of the capacity are large; the plan with the fewest sequences is taken.
LARGE = (1 / 2, 1 / 3, 1 / 4, 1 / 8)
GROUPS = 96
RANK_SALTS = 64


@dataclass
class Run:
    """``count`` sequences alike, numbered from ``first``, filled up to ``used``."""

    first: int
    count: int
    used: int


class Plan:
    """Assignments of rank ranges: rank r of ``length`` from ``rank`` on goes to sequence first + (r-rank)//per."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, dict(counts)
        self.taken = dict.fromkeys(counts, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, rank, count, first, per, offset
        self.by_room: dict[int, list[Run]] = {}
        self.rooms: list[int] = []
        self.sequences = 0

    def open(self, count: int) -> Run:
        run = Run(self.sequences, count, 0)
        self.sequences += count
        return run

    def add(self, run: Run) -> None:
        room = self.capacity - run.used
        if run.count and room:
            if room not in self.by_room:
                insort(self.rooms, room)
                self.by_room[room] = []
            self.by_room[room].append(run)

    def take(self, room: int) -> Run:
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.remove(room)
        return run

    def put(self, run: Run, length: int, per: int) -> None:
        """``per`` documents of this length into each sequence of the run."""
        n = run.count * per
        self.rows.append((length, self.taken[length], n, run.first, per, run.used))
        self.taken[length] += n
        self.left[length] -= n
        run.used += per * length

    def best_fit(self, length: int) -> None:
        while n := self.left[length]:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                run = self.take(room)
            else:
                room = self.capacity
                run = self.open(-(-n // (self.capacity // length)))
            per = room // length
            whole = min(run.count, n // per)
            if whole:
                full = Run(run.first, whole, run.used)
                self.put(full, length, per)
                self.add(full)
            rest = Run(run.first + whole, run.count - whole, run.used)
            if rest.count and (some := min(per - 1, self.left[length])) and whole == n // per:
                one = Run(rest.first, 1, rest.used)
                self.put(one, length, some)
                self.add(one)
                rest = Run(rest.first + 1, rest.count - 1, rest.used)
            self.add(rest)


def linear_groups(counts: dict[int, int], limit: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count)...] falling) of groups of equal cardinality; a length may be in two."""
    large = sorted(((s, n) for s, n in counts.items() if s > limit and n), reverse=True)
    total = sum(n for _, n in large)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    done, room = 0, 0
    for s, n in large:
        while n:
            if not room:
                out.append((s, []))
                room = max(1, total * len(out) // groups - done)
            k = min(n, room)
            out[-1][1].append((s, k))
            n, room, done = n - k, room - k, done + k
    return out


def _price(sizes: np.ndarray, gain: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest gain."""
    worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    rounds = [(worth.copy(), pick.copy())]
    for _ in range(capacity // int(sizes.min())):
        before = rounds[-1][0]
        worth, pick = before.copy(), np.full(capacity + 1, -1)
        for i in np.flatnonzero(gain > 1e-12):
            s = sizes[i]
            new = before[: capacity + 1 - s] + gain[i]
            better = new > worth[s:] + 1e-12
            worth[s:][better] = new[better]
            pick[s:][better] = i
        if (pick < 0).all():
            break
        rounds.append((worth, pick))
    config, at = np.zeros(len(sizes)), capacity
    for _, pick in reversed(rounds[1:]):
        if pick[at] >= 0:
            config[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(rounds[-1][0][capacity]), config


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 600) -> list[tuple[int, list[int]]]:
    """(how often, documents of each size) of the linear programme's solution, rounded down."""
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    level = d / np.diag(basis)
    for _ in range(steps):
        gain = np.linalg.solve(basis.T, np.ones(len(s)))
        value, column = _price(s, np.maximum(gain, 0), capacity)
        if value <= 1 + 1e-7:
            break
        rate = np.linalg.solve(basis, column)
        out = np.flatnonzero(rate > 1e-9)
        ratio = level[out] / rate[out]
        leave = out[np.argmin(ratio)]
        step = max(0.0, float(ratio.min()))
        level = np.maximum(level - step * rate, 0)
        level[leave] = step
        basis[:, leave] = column
    return [(int(level[j] + 1e-9), basis[:, j].astype(int).tolist()) for j in range(len(s)) if level[j] >= 1 - 1e-9]


def pack(counts: dict[int, int], capacity: int = CAPACITY, large: tuple[float, ...] = LARGE, groups: int = GROUPS) -> Plan:
    """The plan for a histogram of lengths from 1 to ``capacity``."""
    return min((_pack(counts, capacity, part, groups) for part in large), key=lambda p: p.sequences)


def _pack(counts: dict[int, int], capacity: int, large: float, groups: int) -> Plan:
    plan = Plan(counts, capacity)
    if n := plan.left.get(capacity):
        plan.put(plan.open(n), capacity, 1)
    grouped = linear_groups({s: n for s, n in plan.left.items() if n}, int(capacity * large), groups)
    if grouped:
        merged: dict[int, list[tuple[int, int]]] = {}
        for size, items in grouped:  # groups rounded to one size are one
            merged.setdefault(size, []).extend(items)
        sizes = list(merged)
        stock = [list(reversed(items)) for items in merged.values()]
        for times, config in configurations(sizes, [sum(n for _, n in v) for v in merged.values()], capacity):
            while times:
                slots = [i for i, k in enumerate(config) for _ in range(k)]
                times_now, chosen = times, []
                # A run ends where one of its slots comes to another length of its group.
                need: dict[int, int] = {}
                for i in slots:
                    need[i] = need.get(i, 0) + 1
                if any(sum(n for _, n in stock[i]) < k for i, k in need.items()):
                    break
                if all(stock[i][-1][1] >= k for i, k in need.items()):
                    times_now = min(times, *(stock[i][-1][1] // k for i, k in need.items()))
                    chosen = [(stock[i][-1][0], k) for i, k in need.items()]
                else:
                    times_now = 1
                    for i, k in need.items():
                        items = list(reversed(stock[i]))
                        for length, n in items:
                            use = min(k, n)
                            if use:
                                chosen.append((length, use))
                                k -= use
                run = plan.open(times_now)
                for length, k in chosen:
                    plan.put(run, length, k)
                plan.add(run)
                for i, k in need.items():
                    gone = k * times_now
                    while gone:
                        length, n = stock[i].pop()
                        use = min(n, gone)
                        gone -= use
                        if n > use:
                            stock[i].append((length, n - use))
                times -= times_now
    for length in sorted((s for s, n in plan.left.items() if n), reverse=True):
        plan.best_fit(length)
    return plan


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids with ``end_id`` behind them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(tokenizer)
        end = np.array([end_id], "<u4")
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate((bpe.encode(text or ""), end))
                cut = len(ids) % capacity or min(len(ids), capacity)
                for k, (x, y) in enumerate(zip([0, *range(cut, len(ids), capacity)], [*range(cut, len(ids) + 1, capacity)], strict=True)):
                    at.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` to a stored table of pieces with ``doc_id, piece, length``."""
    spark = cut.sparkSession
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_SALTS)).cast("int"))
    tally = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity * RANK_SALTS rows
    counts: dict[int, int] = {}
    base = []
    for r in sorted(tally):
        base.append((r["length"], r["_salt"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    plan = pack(counts, capacity)
    bases = spark.createDataFrame(base, "length long, _salt int, _base long")
    ranges = spark.createDataFrame(plan.rows, "length long, _rank long, _n long, _first long, _per long, _at long")
    in_part = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.join(F.broadcast(bases), ["length", "_salt"]).withColumn("_r", F.col("_base") + F.row_number().over(in_part) - 1)
    hit = (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_n"))
    x, y = ranked.alias("x"), F.broadcast(ranges).alias("y")
    joined = x.join(y, (F.col("x.length") == F.col("y.length")) & hit)
    place = F.col("_r") - F.col("_rank")
    return joined.select(
        *[F.col(f"x.{c}") for c in cut.columns],
        (F.col("_first") + F.floor(place / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (place % F.col("_per")) * F.col("x.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Defined cases: null and empty texts are one piece that holds ``end_id`` alone; a document longer than the
    capacity is cut so that its first piece takes the remainder; repeated rows are packed once each; an empty table
    gives an empty result; other columns are ignored.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pack-pieces")
    return pack_pieces(cut, capacity)
