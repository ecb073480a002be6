"""Substring deduplication with one compressed FM-index per shard.

A window is WINDOW consecutive words.  It goes if a document with a smaller id has the same window.

1. Every window has an anchor, the right-most least hash among its GRAM-word grams; equal windows have equal anchors.
   Anchors that only one document has can't belong to a repeated window and go no further.
2. The windows that share an anchor occurrence form a segment of at most 2 * WINDOW - GRAM words.  Segments are merged
   by content first, keeping the smallest id, so copies cost one segment however many there are.
3. Distinct segments are sharded by anchor.  Each shard builds an FM-index of its segments and streams them through it:
   matching statistics by backward search on a wavelet tree give each window's interval of suffixes, and the least id
   among the owners of these suffixes is the answer.
4. An anchor with more than HOT distinct segments (a passage that a large part of the corpus quotes in different
   surroundings) would fill one shard: its segments are cut into single windows, and windows of equal content are
   grouped by their digest.  A pattern of exactly one window needs no index.  Nothing is dropped or capped.
5. Documents get their intervals back and cut the covered words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from citeloom.llm.common import dropped, keyed_join, stored, unused
from citeloom.llm.fm_index import window_minima

WINDOW = 50
GRAM = 8
HOT = 2_000
#: Words of one shard's index.
SHARD_WORDS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only


def owned_windows(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each run of windows that has the same anchor occurrence."""
    n = len(words)
    if n < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    digest = xxhash.xxh64_intdigest
    x = np.fromiter((digest(w) for w in words), np.uint64, n)
    h = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        h = h * _BASE + x[k : k + n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # Right-most least of each run of ``span`` grams, by doubling.
    span = window - gram + 1
    value, place, width = h, np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        a, b = value[:-step], value[step:]
        right = b <= a
        value, place, width = np.where(right, b, a), np.where(right, place[step:], place[:-step]), width + step
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    return value[first].view(np.int64), first, last


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owner = [np.zeros(0, np.int64)], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = owned_windows(words_of(text), window, gram)[0]
                keys.append(found)
                owner.append(np.full(len(found), i, np.int64))
            at = np.concatenate([np.zeros(0, np.int64), *owner])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column(0).take(pa.array(at))], names=["key", "doc_id"])

    return rows.mapInArrow(run, f"key long, doc_id {dict(rows.dtypes)['doc_id']}")


def _segments(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Segments of the documents' shared anchors ``keys``; a task sends each content once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, (text, shared) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                words = words_of(text)
                keys, first, last = owned_windows(words, window, gram)
                known = np.isin(keys, shared.values.to_numpy())
                for k, s, e in zip(keys[known].tolist(), first[known].tolist(), last[known].tolist(), strict=True):
                    content = b" ".join(words[s : e + window])
                    name = xxhash.xxh3_128_digest(content)
                    if len(sent) > 200_000:
                        sent.clear()
                    new = name not in sent
                    sent.add(name)
                    for column, v in zip(out, (i, k, name, s, e - s + window, content if new else None), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary())],
                names=["doc_id", "key", "name", "first", "n", "content"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, key long, name binary, first long, n int, content binary")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """Single windows of segments: ``segment, i, name, least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, place, name = [], [], []
            for r, c in enumerate(b.column(1).to_pylist()):
                words = c.split()
                for i in range(len(words) - window + 1):
                    at.append(r)
                    place.append(i)
                    name.append(xxhash.xxh3_128_digest(b" ".join(words[i : i + window])))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(place, pa.int32()), pa.array(name, pa.binary()), b.column(2).take(take)], names=["segment", "i", "name", "least"])

    kind = dict(rows.dtypes)["least"]
    return rows.select("name", "content", "least").mapInArrow(run, f"segment binary, i int, name binary, least {kind}")


def _search(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``name, minima``: per window of each distinct segment the least id that has it, from one FM-index a shard."""
    total = segments.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    placed = segments.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard").select("shard", "name", "content", "least")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        split = [r[1].split() for r in rows]
        code = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
        found = window_minima([np.fromiter((code[w] for w in s), np.int64, len(s)) for s in split], np.array([r[2] for r in rows], np.int64), len(code) + 1, window)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["name", "minima"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in batches:
            for s, name, content, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard and held:
                    yield solve(held)
                    held = []
                shard = s
                held.append((name, content, least))
        if held:
            yield solve(held)

    return placed.mapInArrow(run, "name binary, minima array<long>")


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each distinct content, with the smallest id that has it."""
    return rows.groupBy("key", "name", "n").agg(F.min("least").alias("least"), F.max("content").alias("content"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, spans``: word ranges [a, b) that repeat a window of a document with a smaller id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    anchors = stored(_anchors(rows, window, gram), "sub-anchors")
    shared = anchors.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    lists = keyed_join(anchors, stored(shared, "sub-shared", narrow=True), ["key"], "left_semi", F.col("doc_id")).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    occurrences = stored(_segments(rows.join(lists, "doc_id"), window, gram), "sub-segments")
    dropped(anchors)
    segments = stored(_merged(occurrences.withColumnRenamed("doc_id", "least")), "sub-distinct")
    crowded = stored(segments.groupBy("key").count().where(F.col("count") > hot).select("key"), "sub-hot", narrow=True)
    crowds = crowded.count()
    found = _search(keyed_join(segments, crowded, ["key"], "left_anti", F.xxhash64("name"), crowds), window, shard_words)
    if crowds:
        single = stored(_windows(keyed_join(segments, crowded, ["key"], "left_semi", F.xxhash64("name"), crowds), window), "sub-windows")
        least = stored(single.groupBy("name").agg(F.min("least").alias("m")), "sub-window-minima")
        back = keyed_join(single.select("segment", "i", "name"), least, ["name"], "inner", F.xxhash64("segment", "i"))
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])
        found = found.unionByName(back.groupBy("segment").agg(ordered.alias("minima")).withColumnRenamed("segment", "name"))
    found = stored(found.where(F.size("minima") > 0), "sub-minima")
    joined = keyed_join(occurrences.select("doc_id", "name", "first"), found, ["name"], "inner", F.col("doc_id"), right_rows=1 << 60)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, start, stop = [], [], []
            for r, (doc, first, minima) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
                hit = np.flatnonzero(minima.values.to_numpy() < doc)
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) > window)
                    for x, y in zip(hit[np.concatenate(([0], cut + 1))].tolist(), hit[np.concatenate((cut, [len(hit) - 1]))].tolist(), strict=True):
                        at.append(r)
                        start.append(first + x)
                        stop.append(first + y + window)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc_id", "a", "b"])

    spans = joined.select("doc_id", "first", "minima").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, a long, b long")
    out = stored(spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans")), "sub-spans", narrow=True)
    for used in (occurrences, segments, found):
        dropped(used)
    return out


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for a, b in spans:
        keep[a:b] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k] if spans else words


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **tuning: int) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256, spans``.

    ``spans`` are the removed word ranges [a, b); ``kept_sha256`` is of the kept words joined by one space.

    Defined cases: null, empty and blank texts have no words and the digest of the empty text; texts under a window
    lose nothing; of equal documents the one with the smallest id keeps its words; repeats inside one document and
    rows that repeat an id don't count as another document; rows with a null id lose nothing; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(repeats(docs, id_col, text_col, window, **tuning), "doc_id", "left").select("doc_id", "text", "spans")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                kept = kept_words(words, [(s["a"], s["b"]) for s in spans or []])
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), b.column(2)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<a: bigint, b: bigint>>")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", window: int = WINDOW, **tuning: int) -> DataFrame:
    """``docs`` with repeated words cut from their texts; a document that loses all its words goes.

    Texts that lose nothing stay as they are; others are their kept words joined by one space, and ``count_col``,
    where the table has it, becomes the new number of characters.
    """
    spans, new = (unused(c, docs.columns) for c in ("_spans", "_new"))
    found = repeats(docs, id_col, text_col, window, **tuning).select(F.col("doc_id").alias(id_col), F.col("spans").alias(spans))
    joined = docs.join(found, id_col, "left").select(*docs.columns, spans)
    at, names = docs.columns.index(text_col), [*docs.columns, new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for text, gone in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                kept = kept_words(words_of(text), [(s["a"], s["b"]) for s in gone]) if gone else None
                cut.append(None if kept is None else b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cut, pa.string())], names=names)

    cut = joined.mapInArrow(run, StructType([*docs.schema.fields, StructField(new, StringType())]))
    changed = F.col(new).isNotNull()
    values = [F.coalesce(F.col(new), F.col(c)).alias(c) if c == text_col else (F.when(changed, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == count_col else F.col(c)) for c in docs.columns]
    return cut.where(~changed | (F.length(new) > 0)).select(*values)
