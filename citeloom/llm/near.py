"""Near-duplicate documents: SimHash ball hashing first, then every pair that a radius of 3 bits can't reach.

Two documents link if the Jaccard similarity of their sets of word shingles (WIDTH words) is at least SIMILARITY.

1. One pass leaves each text's SimHash, and the size, the digest and a small parity sketch of its set.  Equal sets are
   one from then on.
2. Fingerprints meet by ball hashing (``simhash.links``); every pair found is verified on the whole sets.  That joins
   the close copies, which are most of a crowded group.
3. At a similarity of 0.8 fingerprints differ in some 10 bits, far beyond any ball that could be emitted, so the rest is
   found by prefix filtering, which loses no pair: shingles have one order for all texts, and of two sets that are
   similar enough the first shared shingle stands so early in both that the rest can still hold what they must share
   (``overlap``).  Each set sends the shingles of its prefix, about a fifth of them, and sets meet on them.  Up to SMALL
   sets pair each with each; of more, all pair with the first.
4. What shares a crowded meeting point and isn't in one group by then is compared in place, each with each, on the
   parity sketches: they bound the shared shingles from above, so what they reject can't be similar.  The pairs that
   remain are verified like all others.

No step drops a pair unless its ends are linked already or it provably isn't similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import dropped, keyed_join, spread_join, stored
from citeloom.llm.components import components
from citeloom.llm.simhash import SMALL, links, shingle_hashes, simhash

WIDTH = 5
SIMILARITY = 0.8
#: Bits of a set's parity sketch.
SKETCH_BITS = 2_048
#: A shingle met so often is frequent and comes late in the order of shingles; at most so many are told apart.
FREQUENT, FREQUENT_ROWS = 16, 1 << 20
#: Shingles that a task counts at a time.
_COUNTED = 1 << 21
#: Rows of a crowded meeting point that one task compares with each other; larger points are cut into cells.
CELL = 16_384


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 if both are empty."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 1.0


def shingle_similarity(a: str | None, b: str | None, width: int = WIDTH) -> float:
    """Jaccard similarity of the word shingles of two whole texts; 1 if neither has a word."""
    return similarity(np.unique(shingle_hashes(a, width)), np.unique(shingle_hashes(b, width)))


def overlap(a: np.ndarray | int, b: np.ndarray | int, least: float = SIMILARITY) -> np.ndarray:
    """Shingles that two sets of these sizes share at least if their Jaccard similarity is ``least``."""
    return np.ceil(least / (1 + least) * (np.asarray(a) + b) - 1e-9).astype(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity sketch: each shingle flips the bit its hash names, so two sketches differ in at most as many bits as the
    sets differ in shingles."""
    bits = np.bincount((shingles % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")


def profiles(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row a text: ``doc_id, fp, n, name, bits``, its SimHash, and size, digest and sketch of its set of shingles.

    Rows without a ``doc_id`` are counts of shingles, ``key`` and ``n``: a task counts _COUNTED shingles at a time and
    sends those that it has met more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(ids: pa.Array, fp: list[int], n: np.ndarray, name: list[bytes] | None = None, bits: list[bytes] | None = None, key: np.ndarray | None = None) -> pa.RecordBatch:
            fill = pa.nulls(len(n))
            columns = [ids, pa.array(np.array(fp, np.uint64).view(np.int64)) if fp else fill.cast(pa.int64()), pa.array(n, pa.int64())]
            columns += [fill.cast(pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (name, bits)]
            columns.append(fill.cast(pa.int64()) if key is None else pa.array(key.view(np.int64)))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "n", "name", "bits", "key"])

        def counted(kind: pa.DataType) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            more = n > 1
            return out(pa.nulls(int(more.sum()), kind), [], n[more], key=found[more])

        kind = None
        for b in batches:
            fp, n, name, bits = [], [], [], []
            kind = b.column(0).type
            for text in b.column(1).to_pylist():
                hashes = shingle_hashes(text, width)
                found = np.unique(hashes)
                fp.append(simhash(hashes))
                n.append(len(found))
                name.append(xxhash.xxh3_128_digest(found.tobytes()))
                bits.append(sketch(found).tobytes())
                held.append(found)
                size += len(found)
                if size >= _COUNTED:
                    yield counted(kind)
                    held, size = [], 0
            yield out(b.column(0), fp, np.array(n, np.int64), name, bits)
        if held:
            yield counted(kind)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long, n long, name binary, bits binary, key long")


def frequent_shingles(profiled: DataFrame) -> np.ndarray:
    """Hashes of frequent shingles, rarest first, from the counts of ``profiles``.

    What a part of a task has once isn't counted, so some frequent ones may be missing: they make the order of
    ``prefix`` good, and any order gives the same pairs.
    """
    counted = profiled.where("doc_id is null").groupBy("key").agg(F.sum("n").alias("n"))
    least = FREQUENT
    counted = stored(counted.where(F.col("n") >= least), "near-frequent", narrow=True)
    while counted.where(F.col("n") >= least).count() > FREQUENT_ROWS:
        least *= 2
    found = counted.where(F.col("n") >= least).toArrow()  # at most FREQUENT_ROWS
    dropped(counted)
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    return keys[np.lexsort((keys, n))]


def prefix(shingles: np.ndarray, late: np.ndarray, late_rank: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set in the common order, as many as a set of that similarity must share one of.

    The order: what is not in ``late`` (sorted), by hash, then ``late`` by rank.
    """
    n = len(shingles)
    if len(late):
        at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
        known = late[at] == shingles
        shingles = np.concatenate((shingles[~known], shingles[known][np.argsort(late_rank[at[known]])]))
    return shingles[: n - int(np.ceil(least * n - 1e-9)) + 1]


def may_be_similar(size_a: np.ndarray, place_a: np.ndarray, size_b: np.ndarray, place_b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Whether sets whose first shared shingle has these places can be ``least`` similar."""
    shared = overlap(size_a.astype(np.int64), size_b, least)
    return (place_a <= size_a - shared) & (place_b <= size_b - shared)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by the first column, cut so that each key's rows come together."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if kept and (cut or key[0] != kept[0].column(0)[0].as_py()):
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def candidate_pairs(rows: DataFrame, frequent: np.ndarray, width: int = WIDTH, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(a, b)`` of ids that may be similar, the rows of crowded meeting points for ``crossing_pairs``, and the stored
    table that both are read from.

    Defined cases: texts without words send nothing; rows that repeat an id never pair with each other.
    """
    kind = dict(rows.dtypes)["doc_id"]
    order = np.argsort(frequent)
    held = rows.sparkSession.sparkContext.broadcast((frequent[order], order))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = held.value
        for b in batches:
            found = [np.unique(shingle_hashes(t, width)) for t in b.column(1).to_pylist()]
            first = [prefix(s, late, rank, least) if len(s) else s for s in found]
            n = np.fromiter(map(len, first), np.int64, len(first))
            place = np.concatenate([np.zeros(0, np.int64), *map(np.arange, n)])
            sizes = np.repeat(np.fromiter(map(len, found), np.int64, len(found)), n)
            key = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(key), ids, pa.array(sizes, pa.int32()), pa.array(place, pa.int32())], names=["key", "doc_id", "size", "place"])

    met = rows.mapInArrow(emit, f"key long, doc_id {kind}, size int, place int").repartition("key").sortWithinPartitions("key", "doc_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_key(batches):
            key, ids, size, place = (c.to_numpy() for c in part.columns)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            found = [(x := np.flatnonzero(small[:-shift] & (key[shift:] == key[:-shift])), x + shift) for shift in range(1, min(SMALL, len(key)))]
            rest = np.flatnonzero(np.repeat(sizes > SMALL, sizes))
            found.append((np.repeat(starts, sizes)[rest], rest))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            ok = (ids[a] != ids[b]) & may_be_similar(size[a], place[a], size[b], place[b], least)
            pairs = np.flatnonzero(ok)
            yield _met(part, a[pairs], b[pairs], True)
            yield _met(part, rest, rest, False)

    both = stored(met.mapInArrow(meet, f"pair boolean, key long, a {kind}, b {kind}, size int, place int"), "near-met")
    crowded = both.where("not pair").select("key", F.col("a").alias("doc_id"), "size", "place")
    return both.where("pair").select("a", "b"), crowded, both


def _met(part: pa.Table, a: np.ndarray, b: np.ndarray, pair: bool) -> pa.RecordBatch:
    a, b = pa.array(a), pa.array(b)
    key, ids, size, place = (c.combine_chunks() for c in part.columns)
    arrays = [pa.array(np.full(len(a), pair)), key.take(a), ids.take(a), ids.take(b), size.take(a), place.take(a)]
    return pa.RecordBatch.from_arrays(arrays, names=["pair", "key", "a", "b", "size", "place"])


def _with_roots(rows: DataFrame, roots: DataFrame, key: str, root: str) -> DataFrame:
    """``rows`` with the group of ``key``, which is itself where no link has reached it."""
    named = roots.select(F.col("node").alias(key), F.col("root").alias(root))
    return keyed_join(rows, named, [key], "left", F.xxhash64(*rows.columns)).withColumn(root, F.coalesce(root, key))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs whose ends are in different groups."""
    rows = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    return _with_roots(_with_roots(rows, roots, "a", "ra"), roots, "b", "rb").where("ra != rb").select("a", "b")


def crossing_pairs(crowded: DataFrame, sets: DataFrame, roots: DataFrame, least: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``(a, b)`` of all sets that share a crowded meeting point, aren't in one group yet and that sketches don't reject.

    A point of more than ``cell`` rows is cut into blocks, and every pair of blocks is a cell of its own.
    """
    kind = dict(crowded.dtypes)["doc_id"]
    named = _with_roots(crowded, roots, "doc_id", "root")
    points = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("rows")).where("x != y")
    points = stored(points.select("key", F.ceil(F.col("rows") / cell).cast("int").alias("blocks")), "near-open", narrow=True)
    left = stored(keyed_join(named, points, ["key"], "inner", F.col("doc_id")), "near-crowded", narrow=True)
    sketches = stored(keyed_join(sets.select("doc_id", "bits"), left.select("doc_id").distinct(), ["doc_id"], "left_semi"), "near-sketches", narrow=True)
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), "blocks").cast("int")
    dealt = (
        spread_join(left, sketches, "doc_id", F.col("key"))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "key", "block", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("block") == F.col("other")).alias("within"), "doc_id", "size", "place", "root", "bits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_key(batches):
            cells, key, block, side, within, ids, size, place, root = (part.column(c).to_numpy() for c in ("cell", "key", "block", "side", "within", "doc_id", "size", "place", "root"))
            bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint64).reshape(len(cells), -1)
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True):
                found_a, found_b = [], []
                for i in range(at, end - 1):
                    if side[i]:
                        break  # rows of a cell's second block come last and are only compared with the first
                    j = np.arange(i + 1, end)
                    j = j[(root[j] != root[i]) & (ids[j] != ids[i]) & (key[j] == key[i]) & (within[i] | (block[j] != block[i]))]
                    j = j[may_be_similar(size[i], place[i], size[j], place[j], least)]
                    shared = (size[j].astype(np.int64) + size[i] - np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)) // 2
                    j = j[shared >= overlap(size[j].astype(np.int64), size[i], least)]
                    found_a += [i] * len(j)
                    found_b += j.tolist()
                if found_a:
                    column = part.column("doc_id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([column.take(pa.array(found_a)), column.take(pa.array(found_b))], names=["a", "b"])

    ordered = dealt.repartition("cell").sortWithinPartitions("cell", "side", "doc_id")
    out = stored(ordered.mapInArrow(run, f"a {kind}, b {kind}").distinct(), "near-crossing", narrow=True)
    for used in (left, points, sketches):
        dropped(used)
    return out


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _shingled(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t, width)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, shingles binary")


def similar_pairs(rows: DataFrame, pairs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose whole sets have at least this similarity."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near-ids", narrow=True)
    used = stored(_shingled(keyed_join(rows, ids, ["doc_id"], "left_semi"), width), "near-used")
    left = used.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = used.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    joined = spread_join(spread_join(pairs, left, "a", F.col("b")), right, "b", F.col("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similarity(x, y) >= least for x, y in zip(_sets_of(b.column(2)), _sets_of(b.column(3)), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kinds = dict(pairs.dtypes)
    out = stored(joined.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}"), "near-verified", narrow=True)
    dropped(used)
    dropped(ids)
    return out


def equal_sets(sets: DataFrame) -> DataFrame:
    """``(a, b)``: each document whose set another with a smaller id has, linked to the smallest."""
    firsts = sets.groupBy("name").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("name", "a")
    firsts = stored(firsts, "near-equal", narrow=True)
    return keyed_join(sets.select("name", F.col("doc_id").alias("b")), firsts, ["name"], "inner", F.col("b")).where("a != b").select("a", "b").distinct()


def ball_pairs(sets: DataFrame) -> DataFrame:
    """``(a, b)`` of ids whose fingerprints meet: equal ones with the first that has it, linked ones first with first."""
    kind = dict(sets.dtypes)["doc_id"]
    firsts = stored(sets.groupBy("fp").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("rows")), "near-prints", narrow=True)
    same = keyed_join(sets.select("fp", F.col("doc_id").alias("b")), firsts.where("rows > 1").select("fp", "a"), ["fp"], "inner", F.col("b")).where("a != b").select("a", "b")
    met = stored(links(firsts.select("fp")), "near-links", narrow=True)
    named = met.join(firsts.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    across = named.select(F.least("x", "y").cast(kind).alias("a"), F.greatest("x", "y").cast(kind).alias("b"))
    return same.unionByName(across).distinct()


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``(node, root)`` of every document that is in a group of near-duplicates; the root is the group's smallest id.

    Two documents are in one group if and only if a chain of pairs of at least this similarity joins them.  Defined
    cases: texts without words equal each other and nothing else; fewer words than ``width`` are one shingle; rows with
    a null id are in no group; rows that repeat an id are one document with several texts; an empty table gives none.
    """
    rows = _rows(docs, id_col, text_col)
    profiled = stored(profiles(rows, width), "near-profiles")
    sets = profiled.where("doc_id is not null")
    same = stored(equal_sets(sets), "near-same", narrow=True)
    # An id whose rows hold several texts takes part with all of them.
    several = sets.groupBy("doc_id").agg(F.min("name").alias("x"), F.max("name").alias("y")).where("x != y").select("doc_id")
    others = same.select(F.col("b").alias("doc_id")).distinct().join(several, "doc_id", "left_anti")
    others = stored(others, "near-others", narrow=True)
    one_each, one_text = (keyed_join(x, others, ["doc_id"], "left_anti") for x in (sets, rows))
    close = stored(ball_pairs(one_each), "near-ball", narrow=True)
    linked = same.unionByName(similar_pairs(one_text, close, width, least))
    roots = stored(components(linked, "near-components"), "near-roots", narrow=True)
    pairs, crowded, met = candidate_pairs(one_text, frequent_shingles(profiled), width, least)
    linked = linked.unionByName(similar_pairs(one_text, stored(apart(pairs, roots), "near-pairs", narrow=True), width, least))
    roots = stored(components(linked, "near-components"), "near-roots", narrow=True)
    more = crossing_pairs(crowded, one_each, roots, least, cell)
    dropped(met)
    if not more.isEmpty():
        linked = linked.unionByName(similar_pairs(one_text, more, width, least))
        roots = stored(components(linked, "near-components"), "near-roots", narrow=True)
    dropped(profiled)
    return roots


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; all columns stay.

    Defined cases: those of ``near_links``; rows with a null id stay; rows that repeat an id stay or go together.
    """
    gone = near_links(docs, id_col, text_col, width, least, cell).where("node != root").select(F.col("node").alias(id_col))
    return keyed_join(docs, gone, [id_col], "left_anti")
