"""Near-duplicates by SimHash fingerprints linked with meet-in-the-middle ball hashing.

Two fingerprints within RADIUS = 3 bits have a point half-way between them, so both meet on a shared variant if each
emits its ball of half the radius.  For an odd radius one side would need a ball of two bits: 2,081 variants of 64
bits, more than the disk budget for each distinct fingerprint.  The ball is therefore taken in punctured space: one
of BLOCKS blocks of bits is masked.  If two fingerprints differ at all, masking a block that holds a differing bit
leaves at most 2 of them, half of which is 1, so each fingerprint emits all variants within 1 bit of each of its
BLOCKS punctured forms (196 variants of 48 bits).  Variants are shuffled, and the members that meet on one are
verified on all 64 bits.  A meeting point emits a spanning forest of its verified links, not all pairs.

Members of one meeting point differ in the masked bits and at most one other, so it has at most
BLOCKS * 2**16 * 49 distinct members, whatever the size of the table: equal fingerprints are merged first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import dropped, keyed_join, stored
from citeloom.llm.components import components

SEED = 42
RADIUS = 3
BLOCKS = 4
#: Meeting points up to this size are compared by shifts of the sorted rows; larger ones node by node.
SMALL = 8
#: From this many members on, a node's neighbours are looked up by its own ball instead of scanned.
PROBE = 43_745
_ROWS = 1 << 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of a whole text in order, repeats included, A-Z lower-cased; none without words.

    Fewer words than ``width`` are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have set; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        bits = np.unpackbits(hashes[at : at + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a whole text, A-Z lower-cased; 0 without words."""
    return simhash(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(blocks: int = BLOCKS, bits: int = 64) -> list[tuple[int, int]]:
    """(mask, flip) of each variant ``(fp & mask) ^ flip``; a flip also carries the number of the masked block."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    out = []
    for b in range(blocks):
        hole = sum(1 << i for i in range(edges[b], edges[b + 1]))
        out += [(~hole & (1 << bits) - 1, (b << edges[b]) ^ flip) for flip in [0, *(1 << i for i in range(bits) if not hole >> i & 1)]]
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _ball(radius: int) -> np.ndarray:
    one = [1 << i for i in range(64)]
    shells = [[0], one]
    for _ in range(radius - 1):
        shells.append(sorted({a ^ b for a in shells[-1] for b in one if (a ^ b).bit_count() == len(shells)}))
    return np.array([x for s in shells[1:] for x in s], np.uint64)


def forest(members: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the link graph of sorted distinct fingerprints."""
    n = len(members)
    left = np.ones(n, bool)
    parents, kids = [], []
    ball = _ball(radius) if n > PROBE else None
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            if ball is None:
                rest = np.flatnonzero(left)
                found = rest[_distance(members[rest], members[i]) <= radius]
            else:
                near = members[i] ^ ball
                at = np.minimum(np.searchsorted(members, near), n - 1)
                at = at[members[at] == near]
                found = at[left[at]]
            left[found] = False
            parents += [i] * len(found)
            kids += found.tolist()
            stack += found.tolist()
    return members[parents], members[kids]


def _linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified links among rows sorted by (key, fp); each key's rows are all here."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    for shift in range(1, SMALL):
        rows = np.flatnonzero(small[:-shift] & (keys[shift:] == keys[:-shift])) if len(keys) > shift else []
        if not len(rows):
            break
        x, y = fps[rows], fps[rows + shift]
        ok = (x != y) & (_distance(x, y) <= radius)
        a.append(x[ok])
        b.append(y[ok])
    for i in np.flatnonzero(sizes > SMALL):
        x, y = forest(np.unique(fps[starts[i] : starts[i] + sizes[i]]), radius)
        a.append(x)
        b.append(y)
    return a, b


def links(distinct: DataFrame, radius: int = RADIUS, bits: int = 64) -> DataFrame:
    """``(a, b)``: links among distinct ``fp`` values of ``bits`` bits that connect whatever lies within ``radius`` of them.

    The variants cover RADIUS bits; a smaller radius is verified, a larger one refused.
    """
    if radius > RADIUS:
        raise ValueError(f"radius: at most {RADIUS}, which the variants cover")
    keys = [F.col("fp").bitwiseAND(F.lit(_signed(m))).bitwiseXOR(F.lit(_signed(f))) for m, f in variants(bits=bits)]
    met = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_k, kept_f = [], []  # the rows of the last key, which may go on in the next batch

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(k, f, radius)
            pairs = np.unique(np.stack([np.concatenate(a or [f[:0]]), np.concatenate(b or [f[:0]])], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            k, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(k):
                continue
            f = f.view(np.uint64)
            cut = int(np.searchsorted(k, k[-1]))
            if kept_k and (cut or k[0] != kept_k[0][-1]):
                yield out(np.concatenate([*kept_k, k[:cut]]), np.concatenate([*kept_f, f[:cut]]))
                kept_k, kept_f = [], []
            elif cut:
                yield out(k[:cut], f[:cut])
            kept_k.append(k[cut:])
            kept_f.append(f[cut:])
        if kept_k:
            yield out(np.concatenate(kept_k), np.concatenate(kept_f))

    return met.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest id that links of at most ``radius`` differing bits reach.  Defined cases: null,
    empty and blank texts have fingerprint 0 and link like any other; fewer words than ``width`` are one shingle;
    copies and repeated rows share a fingerprint and so a component; an empty table gives an empty result; other
    columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash-docs")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct", narrow=True)
    found = stored(components(links(distinct.select("fp"), radius), "simhash-links"), "simhash-roots", narrow=True)
    joined = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = stored(joined, "simhash-rooted", narrow=True)
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    mapped = stored(joined.join(least, "root").select("fp", "component_id"), "simhash-components", narrow=True)
    dropped(joined)
    return keyed_join(prints, mapped, ["fp"], "left", F.col("doc_id"))
