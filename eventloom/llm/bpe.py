"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding. With
those last tokens stored, the encoding of any prefix is read off backwards, appended bytes
cost only themselves, and an edit is encoded again only until the old state returns.

A candidate last token is right if it may stand after the last token of what precedes it,
that is, if merging the bytes of both would not have joined across their border earlier.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.arrays import held, slices

#: Pieces kept with their ids in one worker, and the longest piece that is kept.
CACHED_PIECES = 150_000
CACHED_LENGTH = 48


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank. The file is read once, by the driver."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def find_halves(tokens: list[bytes]) -> list[tuple[int, int] | None]:
    """The two tokens whose merge makes each token; a byte is its own half; None: no merge makes it."""
    ranks = {token: rank for rank, token in enumerate(tokens)}
    halves: list[tuple[int, int] | None] = []
    for rank, token in enumerate(tokens):
        if len(token) == 1:
            halves.append((rank, rank))
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(joined)
            if least >= rank:
                break
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        halves.append((ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None)
    return halves


class Vocabulary:
    """Tokens, their halves, and the automaton that finds all tokens that end at a byte."""

    def __init__(self, tokens: list[bytes], halves: list[tuple[int, int] | None], pattern: str):
        self.tokens = tokens
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.left = [half[0] if half else -1 for half in halves]
        self.right = [half[1] if half else -1 for half in halves]
        self.merged = {half: rank for rank, half in enumerate(halves) if half and len(tokens[rank]) > 1}
        self.lengths = [len(token) for token in tokens]
        self.longest = max(self.lengths)
        self.split = regex.compile(pattern)
        self.found = ahocorasick.Automaton()
        for rank, token in enumerate(tokens):
            if halves[rank]:
                self.found.add_word(token.decode("latin-1"), rank)
        self.found.make_automaton()
        self.neighbours: dict[int, bool] = {}
        self.pieces = PieceCache(self)

    def may_follow(self, first: int, second: int) -> bool:
        """Whether ``first second`` is what merging their joined bytes gives."""
        if len(self.neighbours) >= CACHED_PIECES:
            self.neighbours.clear()
        fits = self.neighbours[first << 32 | second] = self._may_follow(first, second)
        return fits

    def _may_follow(self, first: int, second: int) -> bool:
        # undo merges on both sides of the border, the latest first; a pair at the border that
        # merges before the step undone last would have been merged across the border
        before = len(self.tokens)
        while True:
            if self.merged.get((first, second), before) < before:
                return False
            undo_first = first > second if self.lengths[first] > 1 and self.lengths[second] > 1 else self.lengths[first] > 1
            if undo_first:
                before, first = first, self.right[first]
            elif self.lengths[second] > 1:
                # of two equal ranks the left one merges first, so a tie at the border counts as earlier
                before, second = second + 1, self.left[second]
            else:
                return True

    def extend(self, last: list[int], data: str) -> None:
        """Add the last tokens of the prefixes of ``data`` (latin-1) beyond ``len(last)``."""
        size = len(last)
        lengths, known, may_follow = self.lengths, self.neighbours.get, self.may_follow
        for end, token in self.found.iter(data, max(0, size - self.longest)):
            if end != size:  # an end that has its token
                continue
            start = end + 1 - lengths[token]
            if start:
                first = last[start - 1]
                fits = known(first << 32 | token)
                if not (may_follow(first, token) if fits is None else fits):
                    continue
            last.append(token)
            size += 1

    def tail(self, last: list[int]) -> list[int]:
        """The encoding of the whole string, read backwards from its last token."""
        ids, at, lengths = [], len(last), self.lengths
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        last: list[int] = []
        self.extend(last, data.decode("latin-1"))
        return tuple(self.tail(last))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.split.findall(text))), np.int32)


class PieceCache(dict):
    """Ids of short pieces seen by this worker; emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.vocabulary.encode_piece(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class EditableText:
    """A text with its pieces and the last tokens of their prefixes; appends and edits are exact."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.ends: list[int] = []
        self.last: list[list[int]] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> int:
        """Put ``text`` in place of ``[start, end)``; returns how many pieces were encoded again."""
        # a piece is found by looking at most two characters beyond its end
        keep = int(np.searchsorted(self.ends, start - 2, "right"))
        begin = self.ends[keep - 1] if keep else 0
        shift = len(text) - (end - start)
        after = {old + shift: i for i, old in enumerate(self.ends) if old >= end}
        reusable = dict(zip(self._texts(keep), self.last[keep:], strict=True))
        self.text = self.text[:start] + text + self.text[end:]
        ends, last, again, rest = self.ends[:keep], self.last[:keep], 0, None
        for found in self.vocabulary.split.finditer(self.text, begin):
            piece = found.group()
            ends.append(found.end())
            known = reusable.get(piece)
            if known is None:
                known = self._extended(piece, reusable)
                again += 1
            last.append(known)
            if found.end() >= start + len(text) and found.end() in after:
                rest = after[found.end()] + 1
                break
        if rest is not None:
            ends += [old + shift for old in self.ends[rest:]]
            last += self.last[rest:]
        self.ends, self.last = ends, last
        return again

    def _texts(self, first: int) -> list[str]:
        begins = [0, *self.ends]
        return [self.text[begins[i] : begins[i + 1]] for i in range(first, len(self.ends))]

    def _extended(self, piece: str, known: dict[str, list[int]]) -> list[int]:
        data = piece.encode()
        last: list[int] = []
        for old, state in known.items():
            if piece.startswith(old) and len(state) > len(last):
                last = list(state)
        self.vocabulary.extend(last, data.decode("latin-1"))
        return last

    def ids(self) -> list[int]:
        vocabulary, out, begin = self.vocabulary, [], 0
        for end, last in zip(self.ends, self.last, strict=True):
            whole = vocabulary.ranks.get(self.text[begin:end].encode())
            out += [whole] if whole is not None else vocabulary.tail(last)
            begin = end
        return out


def _vocabulary(key: tuple, tables, pattern: str) -> Vocabulary:
    """One per worker, shared by its tasks."""
    return held(("vocabulary", *key), lambda: Vocabulary(*tables.value, pattern))


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``token_ids`` of every whole text; a null or empty text has no ids.

    ``path`` is a rank file on the driver; its tokens, bounded by the vocabulary, are broadcast.
    Every match of ``pattern`` is encoded separately. Rows stay where they are: no shuffle.
    Repeated rows are encoded each; other columns of ``documents`` are not used.
    """
    tokens = read_ranks(path)
    tables = documents.sparkSession.sparkContext.broadcast((tokens, find_halves(tokens)))
    rows = documents.select(*keys, F.col(text).alias("token_ids"))
    schema = rows.select(*keys, F.lit(None).cast("array<int>").alias("token_ids")).schema
    name = (path, pattern, len(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(name, tables, pattern)
        for batch in batches:
            texts = batch.column("token_ids")
            for part in slices(texts):
                ids, sizes = [], [0]
                for value in texts.slice(part.first, part.rows).to_pylist():
                    found = vocabulary.encode(value or "")
                    ids.append(found)
                    sizes.append(sizes[-1] + len(found))
                flat = pa.array(np.concatenate(ids), pa.int32())
                columns = [c.slice(part.first, part.rows) for c in batch.select(list(keys)).columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], names=[*keys, "token_ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``carry`` and the bytes (``decoded``) of ``token_ids``."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = [*keys, *carry]
    schema = encoded.select(*kept, F.lit(None).cast("binary").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(tokens.value, pa.large_binary())
        for batch in batches:
            lists = batch.column("token_ids")
            # the ids of all rows, looked up together, lie one after the other as bytes
            found = vocabulary.take(lists.flatten())
            offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            borders = offsets[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            data = found.buffers()[2] if len(found) else pa.py_buffer(b"")
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(np.ascontiguousarray(borders)), data])
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, decoded.cast(pa.binary())], names=[*kept, "decoded"])

    return encoded.mapInArrow(run, schema)
