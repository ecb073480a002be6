"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole.  Every token's byte span follows from the running sum of its length; spans
are joined with the sections' spans by interval, and a token that crosses a boundary goes to one section, or is
shared, by an explicit rule:

``first``  to the section that holds its first byte (the default);
``last``   to the section that holds its last byte;
``most``   to the section that holds most of its bytes, the earlier one if equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.tokens import ByteBpe

RULES = ("first", "last", "most")


def line_ends(text: bytes) -> np.ndarray:
    """Ends of the sections of a text: its lines, each with its line feed."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(text) else np.append(at, len(text))


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section; ``sizes``: bytes of each token in order, ``ends``: rising section ends."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.searchsorted(ends, start, side="right")
    if rule == "first":
        owner = first
    else:
        last = np.searchsorted(ends, stop - 1, side="right")
        owner = last
        if rule == "most":
            owner = first.copy()
            for i in np.flatnonzero(first != last):
                edges = np.concatenate(([start[i]], ends[first[i] : last[i]], [stop[i]]))
                owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(np.minimum(owner, len(ends) - 1), minlength=len(ends))


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: ``doc_id, section, start_byte, n_bytes, n_tokens, doc_tokens``; sections are lines.

    The counts of a document's sections add up to ``doc_tokens``, the length of its one encoding.  Defined cases: null
    and empty texts have one section of 0 bytes and 0 tokens; empty lines are sections of their line feed; repeated
    rows give repeated sections; an empty table gives an empty result; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(tokenizer)
        for b in batches:
            at, number, start, size, tokens, whole = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                text = text or ""
                ids = bpe.encode(text)
                ends = line_ends(text.encode("utf-8", "surrogatepass"))
                counts = attribute(bpe.size_of[ids], ends, rule)
                starts = np.concatenate(([0], ends[:-1]))
                at.append(np.full(len(ends), i))
                number.append(np.arange(len(ends)))
                start.append(starts)
                size.append(ends - starts)
                tokens.append(counts)
                whole.append(np.full(len(ends), len(ids)))
            if at:
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (at, number, start, size, tokens, whole)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(columns[0]), *columns[1:]], names=["doc_id", "section", "start_byte", "n_bytes", "n_tokens", "doc_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, section long, start_byte long, n_bytes long, n_tokens long, doc_tokens long")


def field_tokens(docs: DataFrame, tokenizer: str, fields: list[str], separator: str = "\n", rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """One row per document and field, from one encoding of the fields joined by ``separator``.

    ``doc_id, field, n_tokens``; a separator belongs to the field before it.  A null field is empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_f{i}") for i, f in enumerate(fields)])
    end = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(tokenizer)
        for b in batches:
            at, tokens = [], []
            for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                parts = [x.encode("utf-8", "surrogatepass") for x in row]
                ends = np.cumsum([len(p) + (len(end) if k < len(parts) - 1 else 0) for k, p in enumerate(parts)])
                tokens += attribute(bpe.size_of[bpe.encode(separator.join(row))], ends, rule).tolist()
                at += [i] * len(parts)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(fields * b.num_rows, pa.string()), pa.array(tokens, pa.int64())], names=["doc_id", "field", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, field string, n_tokens long")
