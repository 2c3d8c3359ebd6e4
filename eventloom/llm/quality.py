"""Quality rules: statistics of every text, and an isolation forest on them.

A document is anomalous if random splits of its statistics separate it after few steps. The
forest learns from a bounded sample of all documents; its score and the labelled rows give
the threshold. Documents that fail a base rule are rejected whatever the forest says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.arrays import Prefixes, Slice, find_words, let_go, mix, pair_hash, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees besides: ASCII capitals, punctuation, and lines with a word.
MORE = ("n_upper", "n_marks", "n_lines")

_KIND = np.zeros((256, 4), bool)
_KIND[list(b"#*$%&|<>"), 0] = True
_KIND[65:91, 1] = True
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()], 2] = True
_KIND[:, 3] = (np.arange(256) & 0xC0) != 0x80
_KIND[[0x20, 9, 10, 11, 12, 13], 3] = False


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _counts(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(begins, len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def text_statistics(part: Slice) -> dict[str, np.ndarray]:
    """The statistics of each text of a slice."""
    words = find_words(part)
    out = {"n_words": np.diff(words.rows)}
    out["n_symbols"] = _per_row(_KIND[part.data, 0], part.bounds)
    out["word_chars"] = _per_row(_KIND[part.data, 3], part.bounds)
    for name, kind in (("n_upper", 1), ("n_marks", 2)):
        out[name] = _per_row(_KIND[part.data, kind], part.bounds)
    prefixes = Prefixes(part.data)
    row_of = words.row_of()

    # 3-word windows found twice or more in one text
    repeated = np.zeros(len(words.starts) + 1, np.int64)
    if len(words.starts) > 2:
        hashes = prefixes.of(words.starts, words.ends)
        windows = pair_hash(pair_hash(hashes[:-2], hashes[1:-1]), hashes[2:])
        own = np.flatnonzero(row_of[:-2] == row_of[2:])
        often = own[_counts(pair_hash(windows[own], row_of[own].astype(np.uint64))) > 1]
        # +1 where a window begins, -1 after its end: words inside any window stay above 0
        np.add.at(repeated, often, 1)
        np.add.at(repeated, np.minimum(often + 3, len(words.starts)), -1)
    out["n_repeat_words"] = _per_row(np.cumsum(repeated)[:-1] > 0, words.rows)

    # lines with a word: those of the words' positions
    breaks = np.flatnonzero(part.data == 10)
    starts = np.unique(np.concatenate([part.bounds[:-1], breaks + 1]))
    line_of_word = np.searchsorted(starts, words.starts, "right") - 1
    starts = starts[np.unique(line_of_word)] if len(line_of_word) else starts[:0]
    breaks = np.append(breaks, len(part.data))
    ends = np.minimum(breaks[np.searchsorted(breaks, starts)], part.bounds[np.searchsorted(part.bounds, starts, "right")])
    rows = np.searchsorted(part.bounds, starts, "right") - 1
    keys = pair_hash(prefixes.of(starts, ends), rows.astype(np.uint64))
    lines = np.bincount(rows, minlength=part.rows)
    distinct = np.unique(np.stack([rows.astype(np.uint64), keys]), axis=1)[0] if len(rows) else rows
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(distinct.astype(np.int64), minlength=part.rows)
    return out


#: What is one unit of each feature. A tree splits a feature as often as its range is wide, so
#: that lengths and a few repeats, in which good texts differ too, do not hide the others.
UNITS = (0.2, 1.0, 1.0, 4.0, 1.0, 1.0, 16.0)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """All rule statistics in ``UNITS``: ratios that do not depend on a text's length, and the length."""
    count = {name: np.asarray(values, np.float64) for name, values in counts.items()}
    words, chars, lines = (np.maximum(count[n], 1) for n in ("n_words", "word_chars", "n_lines"))
    found = (
        count["n_upper"] / chars,
        count["n_symbols"] / words,
        count["n_marks"] / words,
        count["word_chars"] / words,
        count["n_dup_lines"] / lines,
        count["n_repeat_words"] / words,
        np.log(words),
    )
    return np.stack(found, axis=1) / UNITS


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), cut, first child, and the path length of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    usual: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; anomalous rows are near 1, for they are separated after few splits."""
        total = np.zeros(len(rows))
        for tree in range(len(self.feature)):
            at = np.zeros(len(rows), np.int64)
            while True:
                feature = self.feature[tree, at]
                inner = np.flatnonzero(feature >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = self.child[tree, node] + (rows[inner, feature[inner]] >= self.cut[tree, node])
            total += self.length[tree, at]
        return 2.0 ** (-total / (len(self.feature) * self.usual))


def _usual_path(size: float) -> float:
    """Mean path length of a search that finds nothing in a binary tree of ``size`` rows."""
    if size <= 1:
        return 0.0
    return 1.0 if size == 2 else 2 * (np.log(size - 1) + np.euler_gamma) - 2 * (size - 1) / size


def grow_forest(sample: np.ndarray, trees: int, rows_per_tree: int, seed: int) -> Forest:
    """Trees over random rows of the sample, split at random values of features drawn by their range."""
    random = np.random.default_rng(seed)
    size = min(rows_per_tree, len(sample))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 * max(1, size)
    feature = np.full((trees, nodes), -1, np.int64)
    cut, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    child = np.zeros((trees, nodes), np.int64)
    for tree in range(trees):
        waiting = [(0, random.choice(len(sample), size, replace=False) if size else np.zeros(0, int), 0)]
        used = 1
        while waiting:
            node, rows, level = waiting.pop()
            low, high = (sample[rows].min(0), sample[rows].max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
            if level >= depth or len(rows) <= 1 or not (high > low).any():
                length[tree, node] = level + _usual_path(len(rows))
                continue
            pick = random.choice(len(low), p=(high - low) / (high - low).sum())
            value = random.uniform(low[pick], high[pick])
            right = sample[rows, pick] >= value
            if right.all() or not right.any():
                value, right = high[pick], sample[rows, pick] >= high[pick]
            feature[tree, node], cut[tree, node], child[tree, node] = pick, value, used
            waiting += [(used, rows[~right], level + 1), (used + 1, rows[right], level + 1)]
            used += 2
    return Forest(feature, cut, child, length, max(_usual_path(size), 1.0))


def rule_statistics(
    documents: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), carry: tuple[str, ...] = (), forest: Forest | None = None
) -> DataFrame:
    """``keys``, ``carry`` and the counts of every whole text; a null text counts as empty.

    With a ``forest``, ``anomaly`` as well, so that texts which are carried go through one worker only.
    One pass without a shuffle. Repeated rows are counted each.
    """
    names = [*COUNTS, *MORE]
    kept = [*dict.fromkeys([*keys, *carry])]
    rows = documents.select(*kept, F.col(text).alias("__text"))
    scores = [F.lit(0.0).alias("anomaly")] if forest else []
    schema = rows.select(*kept, *[F.lit(0).cast("long").alias(n) for n in names], *scores).schema
    shared = documents.sparkSession.sparkContext.broadcast(forest) if forest else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch.column("__text")):
                found = text_statistics(part)
                columns = [c.slice(part.first, part.rows) for c in batch.select(kept).columns]
                columns += [pa.array(found[n].astype(np.int64)) for n in names]
                if shared:
                    columns.append(pa.array(shared.value.scores(features(found))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class QualityModel:
    forest: Forest
    threshold: float


def sampled(statistics: DataFrame, rows: int, seed: int, key: str = "doc_id") -> np.ndarray:
    """Features of about ``rows`` documents, those with the least seeded hashes of their key and statistics."""
    names = [*COUNTS, *MORE]
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), *names, F.lit(seed)), F.lit(1 << 40))
    share = min(1.0, rows / max(1, statistics.count()))
    taken = statistics.where(draw < int(share * (1 << 40))).select(*names).limit(2 * rows).toPandas().sort_values(names)
    return features({n: taken[n].to_numpy() for n in names})


def anomaly_scores(statistics: DataFrame, forest: Forest, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``anomaly`` of every row of ``rule_statistics``."""
    names = [*COUNTS, *MORE]
    shared = statistics.sparkSession.sparkContext.broadcast(forest)
    schema = statistics.select(*keep, F.lit(0.0).alias("anomaly")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features({n: batch.column(n).to_numpy(zero_copy_only=False) for n in names})
            yield pa.RecordBatch.from_arrays([*batch.select(list(keep)).columns, pa.array(shared.value.scores(rows))], names=[*keep, "anomaly"])

    return statistics.mapInArrow(run, schema)


def base_failed(min_words: int = 50, repeat_percent: int = 50):
    """Fixed rules: too few words, or too many of them in repeated 3-word windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def calibrated(scored: DataFrame, labels: DataFrame, cost: float, bins: int = 2000) -> float:
    """The threshold with the best difference of bad documents caught and good ones lost.

    Both are shares of the labelled documents; losing a share of the good ones counts ``cost``
    times. ``scored`` has ``doc_id`` and ``anomaly``; ``labels`` has ``doc_id`` and ``quality``.
    Labels are counted in bins of the score, so what reaches the driver does not grow with
    them. Without labelled documents of both kinds nothing is rejected.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    bin_of = F.least(F.floor(F.col("anomaly") * bins), F.lit(bins - 1))
    rows = scored.select("doc_id", bin_of.alias("bin")).join(known, "doc_id").groupBy("bin", "quality").count().collect()
    good, bad = np.zeros(bins + 1, np.int64), np.zeros(bins + 1, np.int64)
    for row in rows:
        (good if row["quality"] > 0 else bad)[int(row["bin"])] += row["count"]
    if not good.sum() or not bad.sum():
        return 2.0
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    caught = np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = caught - cost * lost
    return float(np.flatnonzero(gain == gain.max())[-1]) / bins


def fit(
    statistics: DataFrame, labels: DataFrame, trees: int = 128, rows_per_tree: int = 128, sample_rows: int = 16384, cost: float = 20.0, seed: int = 7
) -> QualityModel:
    """A forest from about ``sample_rows`` documents, and a threshold from all labelled ones.

    ``statistics`` should be a written table: it is read twice. Documents that fail the base
    rules take part in neither, as their verdict is fixed.
    """
    open_rows = statistics.where(~base_failed())
    forest = grow_forest(sampled(open_rows, sample_rows, seed), trees, rows_per_tree, seed)
    return QualityModel(forest, calibrated(anomaly_scores(open_rows, forest, ("doc_id",)), labels, cost))


def judge(statistics: DataFrame, model: QualityModel, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``anomaly``, ``base_failed`` and the verdict ``kept``; statistics that have ``anomaly`` keep it."""
    columns = tuple(dict.fromkeys([*keep, *COUNTS]))
    scored = statistics.select(*columns, "anomaly") if "anomaly" in statistics.columns else anomaly_scores(statistics, model.forest, columns)
    return (
        scored
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < model.threshold))
    )
