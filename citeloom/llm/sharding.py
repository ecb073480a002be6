"""Sharding by a minimax contiguous partition of atomic groups (equal texts).

The smallest feasible shard capacity is found by binary search with a greedy check.  The check needs, for a start
``s`` and a capacity ``C``, the last group boundary at or below ``s + C``.  The boundaries (prefix sums of group
bytes) stay in a table.  The driver holds some of them only: the ends of at most MAX_BLOCKS blocks at first.  A gap
between two known boundaries leaves the greedy check with a lower and an upper answer; where the two differ for
capacities still in question, the gaps concerned are read at a finer grid in one small job, until they agree.
The optimum is exact, and what reaches the driver is bounded by GRID rows a round.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import stored

HASH_BLOCKS = 64
CLASSES_PER_OCTAVE = 8
#: Sizes have at most 41 octaves of CLASSES_PER_OCTAVE classes, each in HASH_BLOCKS blocks.
MAX_BLOCKS = 41 * CLASSES_PER_OCTAVE * HASH_BLOCKS
GRID = 16_384
#: Sub-keys of a group, so that one huge group is counted and numbered by many tasks.
SALTS = 256


class Boundaries:
    """Known prefix sums of an ordered list of atomic sizes; ``whole[i]``: no other boundary before ends[i]."""

    def __init__(self, base: int) -> None:
        self.ends, self.whole = [base], [True]

    def put(self, found: list[tuple[int, bool]]) -> None:
        known = dict(zip(self.ends, self.whole, strict=True))
        for end, whole in found:
            known[end] = known.get(end, False) or whole
        self.ends = sorted(known)
        self.whole = [known[e] for e in self.ends]

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the last boundary at or below ``x``."""
        i = bisect_right(self.ends, x) - 1
        low = self.ends[i]
        if i + 1 < len(self.ends) and not self.whole[i + 1]:
            return low, min(x, self.ends[i + 1] - 1)
        return low, low

    def walk(self, capacity: int, shards: int, upper: bool) -> tuple[list[int], bool]:
        """Greedy cuts at this capacity and whether ``shards`` of them reach the end."""
        p, cuts = self.ends[0], []
        for _ in range(shards):
            p = self.floor(p + capacity)[upper]
            cuts.append(p)
            if p >= self.ends[-1]:
                return cuts, True
        return cuts, False

    def smallest(self, low: int, high: int, shards: int, upper: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.walk(mid, shards, upper)[1] else (mid + 1, high)
        return low

    def open_windows(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Gaps not yet resolved that greedy cuts of capacities from low to high can fall in."""
        first, last = self.walk(low, shards, False)[0], self.walk(high, shards, True)[0]
        first += [self.ends[-1]] * (shards - len(first))
        last += [self.ends[-1]] * (shards - len(last))
        out = set()
        for a, b in zip(first, last, strict=True):
            i = max(1, bisect_right(self.ends, a))
            while i < len(self.ends) and self.ends[i - 1] <= b:
                if not self.whole[i]:
                    out.add((self.ends[i - 1], self.ends[i]))
                i += 1
        merged: list[tuple[int, int]] = []
        for a, b in sorted(out):
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        return merged


def minimax_cuts(known: Boundaries, largest: int, shards: int, refine) -> tuple[int, list[int]]:
    """Smallest capacity and its greedy cuts; ``refine(windows)`` gives finer boundaries inside windows."""
    end = known.ends[-1]
    total = end - known.ends[0]
    floor = max(largest, -(-total // shards))
    while True:
        low = known.smallest(floor, max(floor, total), shards, True)
        high = known.smallest(low, max(floor, total), shards, False)
        if low == high:
            return high, known.walk(high, shards, False)[0]
        known.put(refine(known.open_windows(low, high, shards)))


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``; equal texts share a shard.

    ``size`` is the text's UTF-8 bytes plus 8.  Groups stand in order of falling size class, then of their text's
    SHA-256; groups above an even share come first and get a shard each, and the minimax partition divides the rest
    among the remaining shards, so a hot group doesn't leave other shards empty.  ``slot`` numbers a shard's rows
    from 0 without gaps.

    Defined cases: null and empty texts form one group of size 8 a row; fewer groups than shards leave the last
    shards empty; rows that repeat an id get slots of their own; an empty table gives an empty result; other columns
    are ignored.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("g"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("s"),
    )
    # A group has at most SALTS rows here, whatever its size.
    parts = rows.groupBy("g", "s").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    of_group = Window.partitionBy("g")
    before = of_group.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(
        parts.select(
            "g",
            "s",
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(of_group).alias("bytes"),
            F.sum("part_rows").over(of_group).alias("n"),
            (F.row_number().over(of_group.orderBy("s")) == 1).alias("first"),
        ),
        "shard-parts",
        narrow=True,
    )
    groups = parts.where("first").select("g", "bytes", "n")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left = [], total
    for r in groups.orderBy(F.desc("bytes"), "g").limit(shards).collect():  # at most one row a shard
        if shards - len(alone) > 1 and r["bytes"] * (shards - len(alone)) > left:
            alone.append(r)
            left -= r["bytes"]
        else:
            break
    octave = F.floor(F.log2("bytes") * CLASSES_PER_OCTAVE).cast("int")
    for i, r in enumerate(alone):
        octave = F.when(F.col("g") == F.lit(bytes(r["g"])), F.lit(100_000 - i)).otherwise(octave)
    groups = groups.select("g", "bytes", "n", octave.alias("cls"), F.pmod(F.xxhash64("g"), F.lit(HASH_BLOCKS)).cast("int").alias("hb"))
    blocks = groups.groupBy("cls", "hb").agg(F.sum("bytes").alias("bb"), F.sum("n").alias("bn"), F.count(F.lit(1)).alias("bc"), F.max("bytes").alias("bm"))
    in_order = Window.orderBy(F.desc("cls"), "hb").rowsBetween(Window.unboundedPreceding, -1)  # over at most MAX_BLOCKS rows
    blocks = stored(
        blocks.select("cls", "hb", "bb", "bc", "bm", F.coalesce(F.sum("bb").over(in_order), F.lit(0)).alias("bytes_at"), F.coalesce(F.sum("bn").over(in_order), F.lit(0)).alias("rows_at")),
        "shard-blocks",
        narrow=True,
    )
    inside = Window.partitionBy("cls", "hb").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(
        groups.join(F.broadcast(blocks.select("cls", "hb", "bytes_at", "rows_at")), ["cls", "hb"]).select(
            "g",
            (F.col("bytes_at") + F.sum("bytes").over(inside)).alias("bytes_end"),
            (F.col("rows_at") + F.sum("n").over(inside) - F.col("n")).alias("rows_start"),
        ),
        "shard-groups",
        narrow=True,
    )

    def refine(windows: list[tuple[int, int]]) -> list[tuple[int, bool]]:
        width = max(1, sum(b - a for a, b in windows) // GRID)
        edges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows])
        here = F.exists(edges, lambda w: (F.col("bytes_end") > w["a"]) & (F.col("bytes_end") <= w["b"]))
        cells = placed.where((F.col("bytes_end") > windows[0][0]) & (F.col("bytes_end") <= windows[-1][1])).where(here).groupBy(F.floor(F.col("bytes_end") / F.lit(width)).alias("cell")).agg(F.min("bytes_end").alias("a"), F.max("bytes_end").alias("b"), F.count(F.lit(1)).alias("c")).collect()
        # Every group end inside the windows is in a cell: nothing stands before a cell's first end, and nothing
        # between its first and last if it has two.
        found = [(r["a"], True) for r in cells] + [(r["b"], r["c"] <= 2) for r in cells]
        return found

    base = sum(r["bytes"] for r in alone)
    known = Boundaries(base)
    summary = blocks.where(F.col("cls") < 50_000).orderBy("bytes_at").collect()  # at most MAX_BLOCKS rows
    known.put([(r["bytes_at"] + r["bb"], r["bc"] == 1) for r in summary])
    cuts = [sum(r["bytes"] for r in alone[: i + 1]) for i in range(len(alone))]
    if summary:
        cuts += minimax_cuts(known, max(r["bm"] for r in summary), shards - len(alone), refine)[1]
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + F.when(F.col("bytes_end") > F.lit(c), 1).otherwise(0)
    placed = placed.select("g", shard.cast("int").alias("shard"), "rows_start")
    starts = {r["shard"]: r["at"] for r in placed.groupBy("shard").agg(F.min("rows_start").alias("at")).collect()}  # a row a shard
    at = F.lit(0)
    for k, v in starts.items():
        at = F.when(F.col("shard") == k, F.lit(v)).otherwise(at)
    where = parts.select("g", "s", "rows_before").join(placed, "g").select("g", "s", "shard", (F.col("rows_start") - at + F.col("rows_before")).alias("slot_at"))
    number = F.row_number().over(Window.partitionBy("g", "s").orderBy("doc_id")) - 1
    return rows.join(where, ["g", "s"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot_at") + number).cast("long").alias("slot"))
