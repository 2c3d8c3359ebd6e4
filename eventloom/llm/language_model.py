"""Interpolated modified Kneser-Ney n-gram model.

Words are numbered first, frequent ones low. Tasks count the n-grams of their texts and send them, as sorted
and packed word numbers, to shards by ranges of a 64-bit hash. A shard merges what it gets, writes it as arrays
into the shared folder, and sends on what the next lower order needs: distinct left neighbours of the shorter
n-grams, and for each of them how many n-grams follow it once, twice, or more often. Workers map the arrays into
memory and look up the n-grams of their texts in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.arrays import find_words, mix, pair_hash, slices, word_hashes
from eventloom.llm.shared_arrays import map_array, write_array
from eventloom.session import stage, staging_path

END = np.uint64(0x2545F491)
#: Numbers that no word has.
BEGIN, UNKNOWN = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
#: Tokens gathered in a task before they are counted, and before they are scored.
COUNTED = 1_200_000
SCORED = 500_000
#: Bytes of training text for each shard.
SHARD_BYTES = 10 << 20
#: Turns in which the shards of a lower order are merged; the shuffle of a turn is gone before the next.
TURNS = 3

_BLOBS = "shard int, entries binary, numbers binary, seen array<long>"


@dataclass
class Tokens:
    """Words and one end mark for each text; ``position`` counts within the text."""

    hashes: np.ndarray
    position: np.ndarray
    bounds: np.ndarray

    def columns(self, numbers: np.ndarray, order: int) -> list[np.ndarray]:
        """Columns of the n-grams that end at each token, the oldest word first; ``numbers`` has the word of each token."""
        out = []
        for back in range(order - 1, -1, -1):
            shifted = numbers
            if back:
                shifted = np.concatenate([np.full(back, BEGIN), numbers[:-back]])[: len(numbers)]
                shifted = np.where(self.position >= back, shifted, BEGIN)
            out.append(shifted)
        return out


def _tokens(parts: list[tuple[np.ndarray, np.ndarray]]) -> Tokens:
    """Join the word hashes and word bounds of several slices."""
    hashes, sizes = [], []
    for words, bounds in parts:
        hashes.append(np.insert(words, bounds[1:], END))
        sizes.append(np.diff(bounds) + 1)
    sizes = np.concatenate(sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return Tokens(np.concatenate(hashes), np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes), bounds)


def _gathered(texts: pa.Array, most: int) -> Iterator[tuple[int, Tokens]]:
    """Tokens of consecutive rows, with the first row of each group."""
    parts, held, first = [], 0, 0
    for part in slices(texts):
        words = find_words(part)
        parts.append((word_hashes(part, words, lower=True), words.rows))
        held += len(words.starts)
        if held >= most:
            yield first, _tokens(parts)
            parts, held, first = [], 0, part.first + part.rows
    if parts:
        yield first, _tokens(parts)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    return reduce(pair_hash, columns[1:], mix(columns[0]))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the keys, so that the shards in turn are in order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _shards(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The shards of sorted keys, and the part of each."""
    shard = _shard(keys, shards)
    borders = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else [0]
    for begin, end in zip(borders[:-1], borders[1:], strict=True):
        yield int(shard[begin]), slice(begin, end)


def _merged(keys: np.ndarray, columns: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """One entry a key, in order, with the sums of its numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64) for n in numbers]
    return keys[first], [c[order[first]] for c in columns], sums


def _narrow(values: np.ndarray) -> np.ndarray:
    """No more bytes a number than the largest one needs."""
    return values.astype(np.min_scalar_type(int(values.max()) if values.size else 0))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of one type, compressed; bytes of the same weight lie side by side."""
    values = np.stack(columns)
    planes = values.view(np.uint8).reshape(*values.shape, values.itemsize).transpose(0, 2, 1)
    return np.array([values.nbytes, values.itemsize]).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer, height: int) -> np.ndarray:
    size, width = np.frombuffer(data[:16], np.int64)
    planes = np.frombuffer(pa.decompress(data[16:], int(size), codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(height, width, -1).transpose(0, 2, 1)).view(f"u{width}").reshape(height, -1)


def _blobs(columns: list[np.ndarray], numbers: list[np.ndarray], shards: int) -> Iterator[tuple]:
    """One row for each shard that gets any of the n-grams."""
    keys, columns, numbers = _merged(_key(columns), columns, numbers)
    for shard, own in _shards(keys, shards):
        # in order of the first two words equal ones lie side by side, which compresses well
        order = np.argsort(reduce(lambda high, low: high << np.uint64(32) | low[own], columns[1:2], columns[0][own].astype(np.uint64)))
        entries = [c[own][order] for c in columns]
        entries[0] = np.diff(entries[0], prepend=np.uint32(0))
        yield shard, _packed(entries), _packed(list(_narrow(np.stack([n[own][order] for n in numbers])))), None


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    names = ("shard", "entries", "numbers", "seen")
    values = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names=list(names))


def _received(table: pa.Table, name: str, height: int) -> list[np.ndarray]:
    return [_unpacked(b.as_buffer(), height) for b in table.column(name)]


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens in _gathered(batch.column(0), COUNTED):
                keys, counts = np.unique(tokens.hashes, return_counts=True)
                rows = [(shard, _packed([keys[own]]), _packed([_narrow(counts[own])]), None) for shard, own in _shards(keys, shards)]
                yield from _table(rows).to_batches()

    return run


def _number_words(folder: str, shards: int):
    """Number the words of one shard from frequent to rare; the shards' numbers alternate, so all frequent words have low ones."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = (np.concatenate(_received(table, name, 1), axis=1)[0] for name in ("entries", "numbers"))
        keys, _, (counts,) = _merged(keys, [], [counts])
        numbers = np.zeros(len(keys), np.int64)
        numbers[np.argsort(-counts, kind="stable")] = np.arange(len(keys)) * shards + shard
        if numbers.max() >= UNKNOWN:
            raise OverflowError("more different words than 32 bits can number")
        _write_parts(folder, f"words-{shard}", [keys, numbers.astype(np.uint32), _narrow(counts)])
        return _table([(shard, None, None, [len(keys), int(counts.sum())])])

    return run


def _count(order: int, folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(folder, shards)
        for batch in batches:
            for _, tokens in _gathered(batch.column(0), COUNTED):
                numbers, _ = lookup.words(tokens.hashes)
                yield from _table(list(_blobs(tokens.columns(numbers, order), [np.ones(len(numbers), np.uint8)], shards))).to_batches()

    return run


def _first_bucket(shard: int, shards: int, bits: int) -> int:
    """The high bits of the least key that a shard can have."""
    return (shard << 32) // shards >> 32 - bits


def _write_parts(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Several arrays of unsigned numbers in one file: their widths and shapes, then each of them from a multiple of 8 bytes."""
    head = np.array([(p.itemsize, len(p), p.size // max(1, len(p))) for p in parts])
    padded = [p.tobytes() + bytes(-p.nbytes % 8) for p in parts]
    write_array(folder, name, np.frombuffer(b"".join([np.int64(len(parts)).tobytes(), head.tobytes(), *padded]), np.uint8))


def _map_parts(folder: str, name: str) -> list[np.ndarray] | None:
    data = map_array(folder, name)
    if data is None:
        return None
    data = np.asarray(data)
    count = int(data[:8].view(np.int64)[0])
    at, parts = 8 + 24 * count, []
    for width, rows, columns in data[8:at].view(np.int64).reshape(count, 3).tolist():
        size = width * rows * columns
        parts.append(data[at : at + size].view(f"u{width}").reshape((rows, columns) if columns > 1 else rows))
        at += size + -size % 8
    return parts


def _write_entries(folder: str, name: str, keys: np.ndarray, numbers: list[np.ndarray], shard: int, shards: int) -> None:
    """Six bytes a key, as the high 16 bits or more are known by its bucket of up to about 32 keys, and one for its numbers.

    The byte names one of the 255 most frequent rows of numbers; other rows are kept whole beside them.
    """
    bits = min(32, max(16, (len(keys) * shards // 32).bit_length()))
    buckets = np.arange(_first_bucket(shard, shards, bits), _first_bucket(shard + 1, shards, bits) + 1)
    starts = np.append(np.searchsorted(keys >> np.uint64(64 - bits), buckets.astype(np.uint64)), len(keys))
    _, sample, kind, counts = np.unique(_key([n.astype(np.uint64) for n in numbers]), return_index=True, return_inverse=True, return_counts=True)
    often = np.argsort(-counts, kind="stable")[:255]
    codes = np.full(len(counts), 255, np.uint8)
    codes[often] = np.arange(len(often))
    codes = codes[kind]
    large = np.flatnonzero(codes == 255)
    rows = np.stack([n[sample[often]] for n in numbers], axis=1)
    middle = (keys >> np.uint64(16)).astype(np.uint32)
    _write_parts(folder, name, [np.array([bits], np.uint8), _narrow(starts), middle, keys.astype(np.uint16), codes, _narrow(rows), _narrow(large), *[_narrow(n[large]) for n in numbers]])


def _reduce(level: int, order: int, folder: str, shards: int):
    """Merge one shard of n-grams, write it, and send on what the next lower order needs.

    Their numbers are the value, and for lower orders the sum of the values that follow, and how many of those are 1, 2, and 3 or more.
    """
    height = 1 if level == order else 5

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = _received(table, "entries", level)
        for part in parts:
            np.cumsum(part[0], out=part[0])
        columns = list(np.concatenate(parts, axis=1))
        keys, columns, numbers = _merged(_key(columns), columns, list(np.concatenate(_received(table, "numbers", height), axis=1)))
        _write_entries(folder, f"order-{level}-{shard}", keys, numbers, shard, shards)
        value, out = numbers[0], []
        seen = [*[int((value == n).sum()) for n in (1, 2, 3, 4)], int((value >= 3).sum()), int(value.sum())]
        if level > 1:
            # an entry without value is only the context of others
            columns, value = [c[value > 0] for c in columns], _narrow(value[value > 0])
            # nothing stands before a text's start: n-grams that begin there keep their counts
            left, none = np.where(columns[1] == BEGIN, value, 1), np.zeros(len(value), np.uint8)
            follows = [value, value == 1, value == 2, value >= 3]
            both = [np.concatenate([after, before]) for after, before in zip(columns[1:], columns[:-1], strict=True)]
            out += _blobs(both, [np.concatenate([left, none]), *[np.concatenate([none, f]) for f in follows]], shards)
        out.append((shard, None, None, seen))
        return _table(out)

    return run


@dataclass
class KneserNey:
    """Where the arrays lie, and the totals: few numbers, whatever the corpus."""

    folder: str
    order: int
    shards: int
    #: different words, and all
    words: int
    tokens: int
    #: for each order: entries with value 1, 2, 3, 4, with 3 or more, and the sum of values
    totals: dict[int, list[int]]

    def discounts(self, level: int) -> np.ndarray:
        """For values 0, 1, 2, and 3 or more; halves where counts of counts are missing."""
        n1, n2, n3, n4, *_ = self.totals[level]
        if not (n1 and n2 and n3 and n4):
            return np.array([0.0, 0.5, 1.0, 1.5])
        y = n1 / (n1 + 2 * n2)
        found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        return np.where(found > 0, np.minimum(found, [0, 1, 2, 3]), [0.0, 0.5, 1.0, 1.5])


def _seen(rows: DataFrame, size: int) -> list[int]:
    found = rows.where("seen IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("seen")[i]), F.lit(0)) for i in range(size)]).first()
    return [int(x) for x in found]


def train(documents: DataFrame, order: int = 3, text: str = "text") -> KneserNey:
    """Count all whole texts of ``documents``; a null text is empty, an empty one has its end only.

    Repeated rows count each. An empty table gives a model without words. Lower orders count distinct left
    neighbours; n-grams that begin with the start of a text have none, and keep their plain counts.
    """
    spark = documents.sparkSession
    folder = staging_path(spark, "language-model")
    texts = documents.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + int(size) // SHARD_BYTES
    found = texts.mapInArrow(_count_words(shards), _BLOBS).repartitionById(shards, "shard").groupBy("shard").applyInArrow(_number_words(folder, shards), _BLOBS)
    words, tokens = _seen(stage(found, "words"), 2)
    sent, totals = [(shards, texts.mapInArrow(_count(order, folder, shards), _BLOBS))], {}
    borders = [shards * turn // TURNS for turn in range(TURNS + 1)]
    for level in range(order, 0, -1):
        # a task for each shard, however many there are
        parts = [rows.repartitionById(size, "shard").groupBy("shard").applyInArrow(_reduce(level, order, folder, shards), _BLOBS) for size, rows in sent]
        merged = reduce(DataFrame.union, [stage(part, f"order-{level}") for part in parts])
        totals[level] = _seen(merged, 6)
        left = merged.where("seen IS NULL")
        sent = [(last - first, left.where(F.col("shard").between(first, last - 1))) for first, last in pairwise(borders) if first < last]
    return KneserNey(folder, order, shards, words, tokens, totals)


class Lookup:
    """The mapped arrays of a model, opened as a worker needs them."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.open: dict[str, list[np.ndarray] | None] = {}

    def _parts(self, name: str) -> list[np.ndarray] | None:
        if name not in self.open:
            self.open[name] = _map_parts(self.folder, name)
        return self.open[name]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of each word."""
        wanted, back = np.unique(hashes, return_inverse=True)
        numbers, counts = np.full(len(wanted), UNKNOWN), np.zeros(len(wanted), np.int64)
        for shard, own in _shards(wanted, self.shards):
            parts = self._parts(f"words-{shard}")
            if parts is None:
                continue
            keys, number, count = parts
            at = np.minimum(np.searchsorted(keys, wanted[own]), len(keys) - 1)
            hit = keys[at] == wanted[own]
            numbers[own][hit], counts[own][hit] = number[at[hit]], count[at[hit]]
        return numbers[back], counts[back]

    def find(self, level: int, keys: np.ndarray, height: int) -> np.ndarray:
        """The numbers of each key; zeros for a key that was not counted."""
        wanted, back = np.unique(keys, return_inverse=True)
        out = np.zeros((len(wanted), height), np.int64)
        for shard, own in _shards(wanted, self.shards):
            parts = self._parts(f"order-{level}-{shard}")
            if parts is None:
                continue
            (bits,), starts, middle, low, codes, rows, large, *wide = parts
            bucket = (wanted[own] >> np.uint64(64 - bits)).astype(np.int64) - _first_bucket(shard, self.shards, int(bits))
            high, rest = (wanted[own] >> np.uint64(16)).astype(np.uint32), wanted[own].astype(np.uint16)
            at, end = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
            stop = end
            for _ in range(int((end - at).max()).bit_length()):
                half = (at + stop) >> 1
                less = (at < stop) & (middle.take(half, mode="clip") < high)
                at, stop = np.where(less, half + 1, at), np.where(less, stop, half)
            hit, left = np.zeros(len(at), bool), np.arange(len(at))
            while len(left):
                # keys that differ in their last bits only lie side by side
                left = left[(at[left] < end[left]) & (middle.take(at[left], mode="clip") == high[left])]
                same = low[at[left]] == rest[left]
                hit[left[same]] = True
                left = left[~same]
                at[left] += 1
            at = at[hit]
            code = codes[at]
            values = rows.reshape(len(rows), -1)[np.minimum(code, len(rows) - 1)].astype(np.int64)
            rare = np.flatnonzero(code == 255)
            values[rare] = np.stack([w[np.searchsorted(large, at[rare])] for w in wide], axis=1)
            out[own][hit] = values
        return out[back]

    def score(self, tokens: Tokens, model: KneserNey) -> tuple[np.ndarray, np.ndarray]:
        """Probability and training count of each token."""
        numbers, count = self.words(tokens.hashes)
        columns = tokens.columns(numbers, model.order)
        # the context of a token is the n-gram that ends before it, or starts only
        before = np.where(tokens.position > 0, np.arange(-1, len(numbers) - 1), len(numbers))
        chance, context = 1.0 / (model.words + 1), None
        for level in range(1, model.order + 1):
            keys = np.append(_key(columns[model.order - level :]), _key([np.array([BEGIN])] * level))
            found = self.find(level, keys, 1 if level == model.order else 5)
            value, discount = found[:-1, 0], model.discounts(level)
            n1, n2, _, _, n3, total = model.totals[level]
            if level > 1:
                total, n1, n2, n3 = context.T
            least = np.maximum(total, 1)
            rest = np.where(total > 0, (n1 * discount[1] + n2 * discount[2] + n3 * discount[3]) / least, 1.0)
            chance = (value - discount[np.minimum(value, 3)]) / least + rest * chance
            context = found[before, 1:]
        return chance, count


_LOOKUPS: dict[str, Lookup] = {}


def _lookup(folder: str, shards: int) -> Lookup:
    """One per worker, shared by its tasks."""
    if folder not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[folder] = Lookup(folder, shards)
    return _LOOKUPS[folder]


def score(documents: DataFrame, model: KneserNey, keep: list[Column | str], text: str = "text") -> DataFrame:
    """``keep``, then n_tokens, n_known, train_tokens, base_score, score, perplexity of each whole text.

    Scores are log10 probabilities, the end of the text included; perplexity is per token.
    Texts stay where they are: no shuffle.
    """
    rows = documents.select(*keep, F.col(text).alias("__text"))
    kept = rows.columns[:-1]
    counts, scores = ("n_tokens", "n_known", "train_tokens"), ("base_score", "score", "perplexity")
    schema = rows.select(*kept, *[F.lit(0).cast("long").alias(n) for n in counts], *[F.lit(0.0).alias(n) for n in scores]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(model.folder, model.shards)
        whole = model.tokens + model.words + 1
        for batch in batches:
            for first, tokens in _gathered(batch.column("__text"), SCORED):
                chance, count = lookup.score(tokens, model)
                starts, sizes = tokens.bounds[:-1], np.diff(tokens.bounds)
                total = np.add.reduceat(np.log10(chance), starts)
                base = np.add.reduceat(np.log10((count + 1) / whole), starts)
                known = np.add.reduceat((count > 0).astype(np.int64), starts)
                columns = [c.slice(first, len(sizes)) for c in batch.select(kept).columns]
                found = [sizes, known, np.full(len(sizes), model.tokens), base, total, 10 ** (-total / sizes)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], names=[*kept, *counts, *scores])

    return rows.mapInArrow(run, schema)


def remainder(divisor: int) -> Column:
    """crc32 of the document's id as text; a row without id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor
