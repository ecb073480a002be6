"""SentencePiece encoding and decoding of a BPE model by a max-plus parallel scan.

The encoding that merging gives is the one sequence of pieces in which every two neighbours are compatible: merging the
two together gives just these two again.  So it is a path through the lattice of piece occurrences whose weight is 0
where neighbours are compatible and minus infinity elsewhere, and exactly one path from end to end has weight 0.  Over
the semiring (max, +) a chunk of text is a matrix from the boundary states before it to those behind it; a state is the
occurrence that holds the character before the boundary and may reach beyond it.  Matrices of neighbouring chunks
combine associatively; a scan over them fixes the state at every boundary, and each chunk is then backtraced by itself.

No piece has a word mark behind another character, so nothing crosses the start of a word and all states there are one.
Chunks are cut at word starts where there is one near; their matrix then is a single number and their words are encoded
one by one, with a cache.  Inside a word longer than a chunk the states are real.

A table takes these steps: chunks of long documents become rows and make their matrices in parallel; a scan over each
document's matrices (mostly one number a chunk) gives the state before and behind every chunk; chunks are traced in
parallel and put together.  Documents of one chunk are encoded as they are read.

A character that no piece covers stands by itself and is written as the byte pieces of its UTF-8 form.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import dropped, stored

MARK = "▁"
#: Characters of a chunk; texts up to GIANT are one chunk.
CHUNK, GIANT = 8_192, 32_768
NEVER = -1e18
#: Words up to this length are merged step by step, which takes the square of their length; longer ones go by the lattice.
_MERGED = 48
_CACHE = 600_000
_WORD = re.compile("▁+[^▁]*")

#: A boundary state: the start and the end of an occurrence, relative to the boundary; WORD where a word starts.
State = tuple[int, int]
WORD: State = (0, 0)


class Pieces:
    """Pieces of a SentencePiece BPE model file, in the order in which they are merged."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        n = sp.get_piece_size()
        self.text = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.score = {p: sp.get_score(i) for p, i in self.text.items()}
        self.longest = max(map(len, self.text))
        self.raw = np.full(n, b"", object)
        for p, i in self.text.items():
            self.raw[i] = p.encode()
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        if any(MARK in p.lstrip(MARK) for p in self.text):
            raise ValueError("a piece of this model crosses the start of a word")
        self.packed = {p: i.to_bytes(4, sys.byteorder) for p, i in self.text.items()}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    @functools.cache
    def load(cls, path: str) -> Pieces:
        return cls(path)

    def ids(self, piece: str) -> bytes:
        """Ids of a piece, or of the bytes of a character that is none, as 32-bit numbers."""
        found = self.packed.get(piece)
        if found is None:
            return np.array([self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")], np.int32).tobytes()
        return found

    def merge(self, text: str) -> list[str]:
        """The model's pieces of a short text: the pair of the highest score is merged first, the left-most if equal."""
        parts, score = list(text), self.score.get
        worth = [score(text[i : i + 2], NEVER) for i in range(len(text) - 1)]
        while worth:
            best = max(worth)
            if best == NEVER:
                break
            at = worth.index(best)
            made = parts[at] = parts[at] + parts[at + 1]
            del parts[at + 1], worth[at]
            if at:
                worth[at - 1] = score(parts[at - 1] + made, NEVER)
            if at < len(worth):
                worth[at] = score(made + parts[at + 1], NEVER)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether b may follow a; ``a`` is empty where a word starts."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > _CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def word(self, word: str) -> bytes:
        """Ids of one word with its marks, packed."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > _CACHE:
                self.words.clear()
            if len(word) <= _MERGED:
                found = b"".join(map(self.ids, self.merge(word)))
            else:
                found = self.trace(Chunk(word, 0, len(word), 0, len(word)), WORD, (self.last(word) - len(word), 0))
            self.words[word] = found
        return found

    def last(self, word: str) -> int:
        """Where the last piece of a word starts."""
        whole = Chunk(word, 0, len(word), 0, len(word))
        row = self.transfer(whole)[0]
        return len(word) + self.states(whole, len(word))[int(np.argmax(row))][0]

    def packed_ids(self, marked: str) -> bytes:
        """Ids of whole words, packed."""
        words = split_words(marked)
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.word(w) if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that stands in one chunk."""
        return np.frombuffer(self.packed_ids(mark(text)), np.int32).tolist()

    def decode(self, ids: np.ndarray) -> str:
        inside = ids[(ids >= 0) & (ids < len(self.raw))]
        return unmark(b"".join(self.raw[inside].tolist()).decode("utf-8", "surrogatepass"))

    # --- one chunk ---

    def starting(self, text: str, at: int) -> Iterator[str]:
        """Pieces that stand in the text from ``at`` on; its character alone if no piece is that character."""
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            if text[at:end] in self.text or end == at + 1:
                yield text[at:end]

    def states(self, chunk: Chunk, at: int) -> list[State]:
        """The states at a boundary of a chunk, in one order for the chunks on both sides."""
        if chunk.word_starts(at):
            return [WORD]
        text, out = chunk.text, []
        for start in range(max(0, at - self.longest), at):
            out += [(start - at, start + len(p) - at) for p in self.starting(text, start) if start + len(p) >= at]
        return out

    def transfer(self, chunk: Chunk) -> np.ndarray:
        """The chunk's matrix, from its states before to its states behind."""
        before, behind = self.states(chunk, chunk.start), self.states(chunk, chunk.end)
        if before == behind == [WORD]:
            return np.zeros((1, 1))
        enter = {s: np.where(np.arange(len(before)) == i, 0.0, NEVER) for i, s in enumerate(before)}
        reached = self._forward(chunk, enter)[0]
        never = np.full(len(before), NEVER)
        return np.stack([reached.get((chunk.end + a, chunk.end + b), never) for a, b in behind], axis=1)

    def _forward(self, chunk: Chunk, enter: dict[State, np.ndarray]) -> tuple[dict[State, np.ndarray], dict[State, State]]:
        """Weights of the occurrences that end at or behind the chunk's end, and of each occurrence the one before it.

        Occurrences are (start, end) in ``chunk.text``; a word start is the empty one, and words that lie between two
        word starts of the chunk are passed over, as all paths through them weigh the same.
        """
        text, start, end = chunk.text, chunk.start, chunk.end
        at: dict[int, dict[State, np.ndarray]] = {}
        for (a, b), v in enter.items():
            at.setdefault(start + b, {})[start + a, start + b] = v
        back: dict[State, State] = {}
        inner = [p for p in chunk.inner() if start <= p <= end]
        for j in sorted({start, *range(start, end + 1)}):
            here = at.get(j)
            if not here:
                continue
            if chunk.word_starts(j):
                # All paths meet; where the words up to the last start are whole, they are left to ``word``.
                best = max(here, key=lambda o: here[o].max())
                joined = functools.reduce(np.maximum, here.values())
                back.setdefault((j, j), best) if best != (j, j) else None
                here = at[j] = {(j, j): joined}
                if inner and j < inner[-1]:
                    at.setdefault(inner[-1], {})[inner[-1], inner[-1]] = joined
                    back[inner[-1], inner[-1]] = (j, j)
                    continue
            if j >= end:
                continue
            for piece in self.starting(text, j):
                k = j + len(piece)
                fits = [o for o in here if self.compatible(text[o[0] : o[1]], piece)]
                if fits:
                    at.setdefault(k, {})[j, k] = functools.reduce(np.maximum, (here[o] for o in fits))
                    back[j, k] = max(fits, key=lambda o: here[o].max())
        return {o: v for j, found in at.items() if j >= end for o, v in found.items()}, back

    def trace(self, chunk: Chunk, before: State, behind: State) -> bytes:
        """Ids of the pieces that start in the chunk on the path between two states, packed."""
        if before == behind == WORD:
            return self.packed_ids(chunk.text[chunk.start : chunk.end])
        back = self._forward(chunk, {before: np.zeros(1)})[1]
        now, parts = (chunk.end + behind[0], chunk.end + behind[1]), []
        first = (chunk.start + before[0], chunk.start + before[1])
        while now != first:
            earlier = back[now]
            if now[0] < now[1]:
                parts.append(self.ids(chunk.text[now[0] : now[1]]))
            elif earlier[0] == earlier[1]:
                parts.append(self.packed_ids(chunk.text[earlier[0] : now[0]]))
            now = earlier
        return b"".join(reversed(parts))


class Chunk:
    """``text[start:end]`` with what lies around it; ``first`` and ``last`` are the marked text's ends in ``text``."""

    def __init__(self, text: str, start: int, end: int, first: int, last: int) -> None:
        self.text, self.start, self.end, self.first, self.last = text, start, end, first, last

    def word_starts(self, at: int) -> bool:
        return at == self.first or (at < self.last and self.text[at] == MARK and self.text[at - 1] != MARK)

    def inner(self) -> list[int]:
        """Word starts in the chunk, its ends included."""
        found = [m.start() + 1 for m in re.finditer("[^▁]▁", self.text[max(0, self.start - 1) : self.end + 1])]
        out = [max(0, self.start - 1) + p for p in found]
        return [self.first, *out] if self.start == self.first else out


def mark(text: str) -> str:
    """Spaces become marks; a mark stands before the first word (the model file's own dummy prefix)."""
    return MARK + text.replace(" ", MARK) if text else ""


def unmark(text: str) -> str:
    return text[1:].replace(MARK, " ") if text.startswith(MARK) else text.replace(MARK, " ")


def split_words(marked: str) -> list[str]:
    """Cuts before each mark that follows another character: no piece crosses there."""
    return _WORD.findall(marked)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; impossible stays NEVER."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by halves: neighbours are combined, and the odd ones follow from them."""
    if len(matrices) < 2:
        return list(matrices)
    halves = prefixes([combine(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(halves[i // 2] if i % 2 else combine(halves[i // 2 - 1], matrices[i]))
    return out


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary, the text's start and end included, on the one path of weight 0."""
    before = [np.zeros(1), *(p[0] for p in prefixes(matrices))]
    states = [int(np.argmax(before[-1]))]
    for m, v in zip(matrices[::-1], before[-2::-1], strict=True):
        states.append(int(np.argmax(v + m[:, states[-1]])))
    return states[::-1]


def cut_points(marked: str, chunk: int = CHUNK) -> list[int]:
    """Where chunks begin and end: the next word start within a chunk's length, else just there."""
    out = [0]
    while len(marked) - out[-1] > chunk:
        at = out[-1] + chunk
        found = re.search("[^▁]▁", marked[at - 1 : at + chunk])
        out.append(at + found.start() if found else at)
    return [*out, len(marked)] if marked and out[-1] < len(marked) else out


def encode_scan(pieces: Pieces, text: str, chunk: int = CHUNK) -> list[int]:
    """The steps on one text."""
    marked = mark(text)
    if not marked:
        return []
    chunks = [Chunk(marked, a, b, 0, len(marked)) for a, b in itertools.pairwise(cut_points(marked, chunk))]
    states = boundary_states([pieces.transfer(c) for c in chunks])
    packed = [pieces.trace(c, pieces.states(c, c.start)[a], pieces.states(c, c.end)[b]) for c, a, b in zip(chunks, states, states[1:], strict=False)]
    return np.frombuffer(b"".join(packed), np.int32).tolist()


_ROW = ["doc_id", "copy", "n"]


def _chunk_of(text: str, start: int, own: int, first: bool, last: bool) -> Chunk:
    """A chunk from its row: ends of the document that aren't in ``text`` lie beyond it."""
    return Chunk(text, start, start + own, 0 if first else -1, len(text) if last else len(text) + 1)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``doc_id, ids``, equal to the library's ids for the whole text.

    Texts over ``giant`` characters are cut into chunks that are encoded as rows of their own.  Defined cases: null
    and empty texts have no ids; white space other than the space is a character like any other; repeated rows are
    encoded each; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for b in batches:
            ids = [np.frombuffer(pieces.packed_ids(mark(t)), np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small = rows.where(F.length("text") <= giant).mapInArrow(short, f"doc_id {kind}, ids array<int>")
    large = rows.where(F.length("text") > giant)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = Pieces.load(model).longest + 1
        for b in batches:
            for r, text in enumerate(b.column(1).to_pylist()):
                marked = mark(text)
                for n, (at, end) in enumerate(itertools.pairwise(cut_points(marked, chunk))):
                    low, high = max(0, at - around), min(len(marked), end + around)
                    values = [pa.array([n], pa.int32()), pa.array([marked[low:high]]), pa.array([at - low], pa.int32()), pa.array([end - at], pa.int32()), pa.array([low == 0]), pa.array([high == len(marked)])]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), b.column(2).slice(r, 1), *values], names=[*_ROW, "text", "start", "own", "first", "last"])

    # Copies of one row are told apart, so that each is encoded by itself; the table is written before it is read twice.
    named = large.withColumn("copy", F.monotonically_increasing_id())
    key = f"doc_id {kind}, copy long, n int"
    chunks = named.select("doc_id", "text", "copy").mapInArrow(cut, f"{key}, text string, start int, own int, first boolean, last boolean")
    chunks = stored(chunks.repartition("doc_id", "n"), "pieces-chunks")
    if chunks.isEmpty():
        dropped(chunks)
        return small

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for b in batches:
            found = [pieces.transfer(_chunk_of(*row)) for row in zip(*(c.to_pylist() for c in b.columns[3:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(m) for m in found], pa.int32()), pa.array([m.ravel() for m in found], pa.list_(pa.float64()))], names=[*_ROW, "size", "matrix"])

    def settle(group: pa.Table) -> pa.Table:
        """States around each chunk of one document."""
        group = group.sort_by("n")
        found = [np.array(m).reshape(size, -1) for m, size in zip(group["matrix"].to_pylist(), group["size"].to_pylist(), strict=True)]
        states = boundary_states(found)
        return pa.table([group["doc_id"], group["copy"], group["n"], pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], names=[*_ROW, "before", "behind"])

    made = chunks.mapInArrow(matrices, f"{key}, size int, matrix array<double>")
    settled = made.groupBy("doc_id", "copy").applyInArrow(settle, f"{key}, before int, behind int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for b in batches:
            ids = []
            for *row, before, behind in zip(*(c.to_pylist() for c in b.columns[3:]), strict=True):
                c = _chunk_of(*row)
                ids.append(np.frombuffer(pieces.trace(c, pieces.states(c, c.start)[before], pieces.states(c, c.end)[behind]), np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=[*_ROW, "ids"])

    # A null id joins itself: the copies' numbers are unique.
    joined = chunks.join(settled.drop("doc_id"), ["copy", "n"]).select(*_ROW, "text", "start", "own", "first", "last", "before", "behind")
    traced = joined.mapInArrow(trace, f"{key}, ids array<int>")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])
    return small.unionByName(traced.groupBy("doc_id", "copy").agg(F.flatten(ordered).alias("ids")).select("doc_id", "ids"))


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``doc_id, ids, text``; null ids give a null text.

    The inverse of ``encode``, except that a null text comes back empty and that U+2581, the word mark itself, becomes
    a space.  Ids outside the vocabulary decode to nothing; an empty table gives an empty result.
    """
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for b in batches:
            texts = [pieces.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, text string")
