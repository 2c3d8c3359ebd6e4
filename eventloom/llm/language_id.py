"""Language of each word by a linear-chain conditional random field, and of each text.

A word's features are its byte trigrams and bigrams with its ends marked, its first and last
bytes, and its place in a lexicon; transitions between the labels of neighbouring words are
learned with them. Forward-backward gives each word the probability of each language in its
text, so that a text may switch between languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.arrays import LOWER, Prefixes, Slice, Words, find_words, slices

#: Rows of a weight table; features are hashed into them. Row 0 stays zero.
ROWS = 1 << 16
_BLOCK = 64
_RUNS = "array<struct<start: int, end: int, lang: string, probability: double>>"
_LETTER = regex.compile(r"\p{L}")


def _fold(code: np.ndarray, salt: int) -> np.ndarray:
    code = (code.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(48)).astype(np.int64) % (ROWS - 1) + 1


@dataclass
class Features:
    """Rows of the weight tables: two for each byte of a word, three for the word."""

    trigram: np.ndarray
    bigram: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def word_features(part: Slice, words: Words, lexicon: np.ndarray) -> Features:
    """Features of all words of a slice; ``lexicon`` holds the sorted hashes of known words."""
    data = LOWER[part.data].astype(np.int64)
    size, starts, ends = len(data), words.starts, words.ends
    inside = np.zeros(size + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    outside = np.cumsum(inside)[:size] == 0
    left, right = np.empty(size, np.int64), np.empty(size, np.int64)
    left[1:], right[:-1] = data[:-1], data[1:]
    left[starts] = 32
    right[ends - 1] = 32
    bigram, trigram = _fold(data * 256 + right, 1), _fold((left * 256 + data) * 256 + right, 2)
    bigram[outside] = trigram[outside] = 0
    prefixes = Prefixes(data)
    hashes = prefixes.of(starts, ends)
    known = np.zeros(len(starts), np.int64)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = np.where(lexicon[at] == hashes, _fold(hashes, 5), 0)
    first, last = prefixes.of(starts, np.minimum(starts + 4, ends)), prefixes.of(np.maximum(ends - 4, starts), ends)
    return Features(trigram, bigram, _fold(first, 3), _fold(last, 4), known, starts, ends)


@dataclass
class Model:
    """Weights by table, feature row and label; ``labels`` are the learned languages, in order."""

    labels: list[str]
    tables: np.ndarray
    transitions: np.ndarray
    begin: np.ndarray
    lexicon: np.ndarray

    def emissions(self, found: Features) -> np.ndarray:
        out = np.empty((len(found.starts), len(self.labels)), np.float32)
        if not len(found.starts):
            return out
        length = np.maximum(found.ends - found.starts, 1)
        for label in range(len(self.labels)):
            tri, bi, pre, suf, lex = self.tables[:, :, label]
            grams = np.add.reduceat(tri[found.trigram] + bi[found.bigram], found.starts)
            out[:, label] = grams / np.sqrt(length) + pre[found.prefix] + suf[found.suffix] + lex[found.lexicon]
        return out


def marginals(model: Model, emissions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of each label for each word, given its whole text (``bounds`` of texts).

    Exact for texts of any length: blocks of words become transfer matrices, which carry the
    forward and backward messages from block to block.
    """
    count, labels = emissions.shape
    if not count:
        return np.zeros((0, labels))
    step, begin = np.exp(model.transitions.astype(np.float64)), np.exp(model.begin.astype(np.float64))
    psi = np.exp((emissions - emissions.max(1, keepdims=True)).astype(np.float64))
    sizes = np.diff(bounds)
    blocks = -(-sizes // _BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    nth = np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)
    start = np.repeat(bounds[:-1], blocks) + nth * _BLOCK
    length = np.minimum(_BLOCK, np.repeat(bounds[1:], blocks) - start)
    by_length = np.argsort(-length, kind="stable")
    active = [by_length[: int(np.count_nonzero(length > j))] for j in range(int(length.max()))]
    opening = nth == 0

    def forward(messages: np.ndarray, own: np.ndarray, j: int) -> np.ndarray:
        moved = messages @ step
        if j == 0:  # the first word of a text follows nothing
            fresh = opening[own]
            moved[fresh] = messages[fresh].sum(-1, keepdims=True) * begin
        weights = psi[start[own] + j]
        moved *= weights[:, None, :] if moved.ndim == 3 else weights
        return moved / moved.max(axis=tuple(range(1, moved.ndim)), keepdims=True)

    transfer = np.broadcast_to(np.eye(labels), (len(start), labels, labels)).copy()
    for j, own in enumerate(active):
        transfer[own] = forward(transfer[own], own, j)
    # messages into each block, from the left and from the right
    texts = np.flatnonzero(blocks)
    texts = texts[np.argsort(-blocks[texts], kind="stable")]
    into, back = np.empty((len(start), labels)), np.empty((len(start), labels))
    left, right = np.full((len(sizes), labels), 1 / labels), np.ones((len(sizes), labels))
    for j in range(int(blocks.max())):
        texts = texts[: int(np.count_nonzero(blocks[texts] > j))]
        own = first_block[texts] + j
        into[own] = left[texts]
        moved = np.einsum("bi,bij->bj", left[texts], transfer[own])
        left[texts] = moved / moved.sum(1, keepdims=True)
        own = first_block[texts + 1] - 1 - j
        back[own] = right[texts]
        moved = np.einsum("bij,bj->bi", transfer[own], right[texts])
        right[texts] = moved / moved.sum(1, keepdims=True)
    out = np.empty((count, labels))
    for j, own in enumerate(active):
        into[own] = forward(into[own], own, j)
        out[start[own] + j] = into[own]
    for j in range(len(active) - 1, -1, -1):
        own = active[j]
        at = start[own] + j
        out[at] *= back[own]
        moved = (psi[at] * back[own]) @ step.T
        back[own] = moved / moved.max(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


def _sequences(texts: list[str], labels: np.ndarray, lexicon_size: int, random: np.random.Generator, length: int):
    """Features of all words, and sequences of word numbers that switch language at one place."""
    part = next(slices(pa.array(texts, pa.large_string()), limit=1 << 40))
    words = find_words(part)
    label_of = labels[words.row_of()]
    hashes = Prefixes(LOWER[part.data].astype(np.int64)).of(words.starts, words.ends)
    values, counts = np.unique(hashes, return_counts=True)
    often = np.argsort(-counts, kind="stable")[:lexicon_size]
    lexicon = np.sort(values[often[counts[often] > 2]])
    found = word_features(part, words, lexicon)
    total = len(words.starts)
    pieces = max(1, total // length)
    starts = random.integers(0, max(1, total - length), (2, 2 * pieces))
    cut = random.integers(1, length, 2 * pieces)
    cut[random.random(2 * pieces) < 0.5] = length
    step = np.arange(length)
    rows = np.where(step < cut[:, None], starts[0][:, None] + step, starts[1][:, None] + step)
    return found, label_of, lexicon, np.minimum(rows, total - 1)


def fit_model(texts: list[str], languages: list[str], lexicon_size: int = 20_000, length: int = 24, batch: int = 64, steps: int = 600, seed: int = 3) -> Model:
    """Learn from a bounded sample by stochastic gradients of the sequences' log-likelihood."""
    names = sorted(set(languages))
    count = len(names)
    model = Model(names, np.zeros((5, ROWS, count), np.float32), np.zeros((count, count)), np.zeros(count), np.zeros(0, np.uint64))
    texts = [t or "" for t in texts]
    if count < 2 or not any(t.strip() for t in texts):
        return model
    random = np.random.default_rng(seed)
    label_of = np.array([names.index(x) for x in languages])
    found, label_of, model.lexicon, sequences = _sequences(texts, label_of, lexicon_size, random, length)
    squares, moved = np.full(model.tables.shape, 1e-3, np.float32), np.full((count + 1, count), 1e-3)
    sizes = found.ends - found.starts
    for _ in range(steps):
        rows = sequences[random.integers(0, len(sequences), batch)]
        words, truth = rows.ravel(), label_of[rows]
        # the bytes of these words, one after the other
        begins = np.concatenate([[0], np.cumsum(sizes[words])])
        own = np.repeat(np.arange(len(words)), sizes[words])
        at = found.starts[words][own] + np.arange(begins[-1]) - begins[:-1][own]
        part = Features(found.trigram[at], found.bigram[at], found.prefix[words], found.suffix[words], found.lexicon[words], begins[:-1], begins[1:])
        emissions = model.emissions(part).astype(np.float64).reshape(batch, length, count)
        posterior, pairs = _expected(model, emissions)
        error = posterior.copy()
        np.put_along_axis(error, truth[..., None], np.take_along_axis(error, truth[..., None], 2) - 1, 2)
        error = error.reshape(-1, count) / batch
        scaled = (error / np.sqrt(sizes[words])[:, None])[own]
        for table, index, weight in ((0, part.trigram, scaled), (1, part.bigram, scaled), (2, part.prefix, error), (3, part.suffix, error), (4, part.lexicon, error)):
            gradient = np.stack([np.bincount(index, weight[:, k], ROWS) for k in range(count)], axis=1).astype(np.float32)
            gradient[0] = 0
            squares[table] += gradient * gradient
            model.tables[table] -= 0.15 * gradient / np.sqrt(squares[table])
        seen = np.zeros((count, count))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        gradient = np.vstack([(pairs - seen) / batch, error.reshape(batch, length, count)[:, 0].sum(0)[None]])
        moved += gradient * gradient
        change = 0.1 * gradient / np.sqrt(moved)
        model.transitions -= change[:-1]
        model.begin -= change[-1]
    return model


def _expected(model: Model, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of labels, and expected numbers of label pairs, for sequences of one length."""
    batch, length, count = emissions.shape
    step = np.exp(model.transitions)
    psi = np.exp(emissions - emissions.max(2, keepdims=True))
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    alpha[:, 0] = np.exp(model.begin) * psi[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        alpha[:, t] = (alpha[:, t - 1] @ step) * psi[:, t]
        alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        beta[:, t] = (psi[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] /= beta[:, t].sum(1, keepdims=True)
    posterior = alpha * beta
    posterior /= posterior.sum(2, keepdims=True)
    joint = alpha[:, :-1, :, None] * step * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return posterior, joint.sum((0, 1))


def train(documents: DataFrame, rows_per_language: int = 500, seed: int = 3) -> Model:
    """A model from a bounded sample of ``documents`` with ``text`` and ``lang``.

    Of each language about ``rows_per_language`` documents are taken, and never more than twice as
    many, by the hash of their id and text; rows without an id, or that repeat one, are drawn by
    their texts. Whole texts are read. The number of languages bounds what reaches the driver.
    """
    places = 1 << 40
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(places))
    known = documents.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", draw.alias("draw"))
    rows = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one a language
    if not rows:
        return fit_model([], [])
    share = F.create_map(*[F.lit(x) for lang, count in rows.items() for x in (lang, max(1, rows_per_language * places // count))])
    taken = known.where(F.col("draw") < F.element_at(share, F.col("lang")))
    # equal rows have equal draws: the least ones of each language, so that they stay bounded
    number = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    bounded = taken.withColumn("number", number).where(F.col("number") <= 2 * rows_per_language)
    sample = bounded.select("text", "lang").orderBy("lang", "text").toPandas()
    return fit_model(list(sample["text"]), list(sample["lang"]), seed=seed)


def predict(documents: DataFrame, model: Model, keep: list[Column | str], text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (mean probability of it over the words), ``shares`` and ``runs``.

    ``shares`` has the mean probability of every learned language: a text that switches has
    several. ``runs`` says where it switches: the words from ``start`` to before ``end``, counted
    from 0, whose likeliest language is ``lang``, with its mean ``probability``. ``und`` with
    score 0 and no runs if the text is null or has no letter, or nothing was learned.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*keep, F.col(text).alias("__text"))
    kept = rows.columns[:-1]
    schema = rows.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("array<double>").alias("shares"), F.lit(None).cast(_RUNS).alias("runs")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column("__text")
            for part in slices(texts):
                shares, found = text_labels(known, part)
                best = shares.argmax(1) if known.labels else np.zeros(part.rows, int)
                values = texts.slice(part.first, part.rows).to_pylist()
                letters = [bool(known.labels) and value is not None and _LETTER.search(value) is not None for value in values]
                names = [known.labels[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, shares.max(1), 0.0) if known.labels else np.zeros(part.rows)
                width = max(1, len(known.labels))
                flat = pa.array(shares.ravel() if known.labels else np.zeros(part.rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * width), flat)
                columns = [c.slice(part.first, part.rows) for c in batch.select(kept).columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score), lists, _run_lists(known, found, np.array(letters))], names=[*kept, "lang_pred", "score", "shares", "runs"])

    return rows.mapInArrow(run, schema)


@dataclass
class Runs:
    """Consecutive words of one text with the same likeliest label; ``start`` and ``end`` count its words."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray
    probability: np.ndarray


def text_labels(model: Model, part: Slice) -> tuple[np.ndarray, Runs]:
    """Mean probability of each label over the words of each text, and the runs of word labels.

    Equal shares and no runs without words.
    """
    words = find_words(part)
    labels = max(1, len(model.labels))
    out, none = np.full((part.rows, labels), 1 / labels), np.zeros(0, np.int64)
    if not len(words.starts) or not model.labels:
        return out, Runs(none, none, none, none, none.astype(float))
    chances = marginals(model, model.emissions(word_features(part, words, model.lexicon)), words.rows)
    full = np.flatnonzero(np.diff(words.rows))
    out[full] = np.add.reduceat(chances, words.rows[:-1][full], axis=0) / np.diff(words.rows)[full][:, None]
    best, row = chances.argmax(1), words.row_of()
    begin = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
    end, first = np.append(begin[1:], len(best)), words.rows[row[begin]]
    sums = np.add.reduceat(chances.max(1).astype(np.float64), begin)
    return out, Runs(row[begin], begin - first, end - first, best[begin], sums / (end - begin))


def text_shares(model: Model, part: Slice) -> np.ndarray:
    """Mean probability of each label over the words of each text; equal shares without words."""
    return text_labels(model, part)[0]


def _run_lists(model: Model, runs: Runs, shown: np.ndarray) -> pa.ListArray:
    """The runs of each text as one list, empty where the text is not ``shown``."""
    own = np.flatnonzero(shown[runs.row])
    names = pa.array(model.labels, pa.string()).take(pa.array(runs.label[own]))
    numbers = [pa.array(v[own].astype(np.int32)) for v in (runs.start, runs.end)]
    structs = pa.StructArray.from_arrays([*numbers, names, pa.array(runs.probability[own])], names=["start", "end", "lang", "probability"])
    counts = np.bincount(runs.row[own], minlength=len(shown))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), structs)
