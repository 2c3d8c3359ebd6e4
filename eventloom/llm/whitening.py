"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X of the fit list are reduced to a small upper bidiagonal matrix B with
X = U B V'. Every step is one pass over the rows, in which each task forms its part of the
product u = X w and of X'u; the driver sees sums of a vector's length only. The columns of U, as
long as the table, are never stored: each is X times a short vector, kept in W. Both sides are
fully reorthogonalised, U against the sums U'u of the pass, V on the driver. The singular value
decomposition of B gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import stage

#: Bytes of rows that are multiplied at once.
_BLOCK_BYTES = 1 << 20
#: With more blocks than this, tasks' sums are added up in Spark before the driver reads them.
_DRIVER_ROWS, _MERGERS = 4096, 64
#: Grid points are kept within 50 bits; only components beyond 1e13 are affected.
_BOUND = float(1 << 50)
#: Relative to the whole matrix, shorter vectors are rounding errors.
_NOTHING = 1e-13
#: Least deviation of a component, relative to the greatest.
_RANK = 1e-11


@dataclass(frozen=True)
class Settings:
    components: int = 16
    scale: int = 64
    offset: int = 1_000_000
    seed: int = 12


@dataclass(frozen=True)
class FitList:
    """Distinct grid vectors in packed blocks, with their exact mean ``base + rest / n``."""

    blocks: DataFrame
    many: bool
    n: int
    sums: tuple[int, ...]

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], object)

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        base, fraction = self.base, np.array([r / self.n for r in self.rest], float)
        return lambda x: (x - base) - fraction


@dataclass(frozen=True)
class Whitening:
    """``directions`` has one column a component, already divided by its deviation."""

    fit: FitList
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float


def grid(vectors: DataFrame, key: str, vector: str, settings: Settings) -> DataFrame:
    """``id`` and ``x``, the vector on the grid of whole numbers, of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    lengths = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("vector") == (usual["size"] if usual else -1))
    cell = lambda c: F.floor(F.greatest(F.lit(-_BOUND), F.least(F.lit(_BOUND), settings.scale * c)))
    return rows.select("id", F.transform("vector", lambda c: cell(c) + settings.offset).alias("x"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _packed(rows: DataFrame) -> DataFrame:
    """Vectors in blocks: ``data`` has the numbers of some rows, ``size`` is that of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), batch.num_rows)
            step = max(1, _BLOCK_BYTES // max(8, 8 * x.shape[1]))
            parts = [x[first : first + step].astype("<i8").tobytes() for first in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["size", "data"])

    return rows.mapInArrow(run, "size int, data binary")


def _added(blocks: DataFrame, many: bool, work: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """The sum of ``work`` over all blocks; ``kind`` is the type of its numbers."""

    def one(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], names=["sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for size, data in zip(batch.column("size").to_pylist(), batch.column("data"), strict=True):
                part = work(np.frombuffer(data.as_buffer(), "<i8").reshape(-1, size))
                total = part if total is None else total + part
        yield from one(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("sums"):
                part = np.frombuffer(data.as_buffer(), kind)
                total = part if total is None else total + part
        yield from one(total)

    sums = blocks.mapInArrow(run, "sums binary")
    if many:
        sums = sums.repartition(_MERGERS).mapInArrow(merge, "sums binary")
    parts = [np.frombuffer(row["sums"], kind) for row in sums.collect()]
    return np.sum(parts, axis=0) if parts else None


def fit_list(rows: DataFrame) -> FitList | None:
    """Each distinct vector once; None without any."""
    blocks = stage(_packed(rows.select("x").distinct()), "fit-blocks")
    many = blocks.count() > _DRIVER_ROWS

    def count(x: np.ndarray) -> np.ndarray:
        # high and low parts are added apart, so that no sum overflows
        return np.concatenate([[len(x)], (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)])

    found = _added(blocks, many, count, "<i8")
    if found is None or len(found) == 1:
        return None
    high, low = found[1:].reshape(2, -1).tolist()
    return FitList(blocks, many, int(found[0]), tuple((h << 26) + x for h, x in zip(high, low, strict=True)))


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What is left of a vector without its parts along the columns of an orthonormal basis."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(fit: FitList, norm: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """V (columns) and the upper bidiagonal B of the centred rows: X'X = V B'B V'.

    As many steps as a vector has entries, so that repeated singular values are found as often
    as they occur: where a sequence ends early, it begins again with a random vector orthogonal
    to all before.
    """
    size = len(fit.sums)
    random = np.random.default_rng(seed)
    centred = fit.centred()
    right, weights, back = np.zeros((size, 0)), np.zeros((size, 0)), np.zeros((size, 0))
    entries: list[tuple[int, int, float]] = []
    vector = random.normal(size=size)
    for step in range(size):
        length = np.linalg.norm(vector)
        if step == 0 or length <= _NOTHING * norm:
            vector = _orthogonal(random.normal(size=size), right)
            length = np.linalg.norm(vector)
        elif step:
            entries.append((back.shape[1] - 1, step, length))
        vector = _orthogonal(vector / length, right)
        vector /= np.linalg.norm(vector)
        right = np.column_stack([right, vector])
        # of X v, take away the parts along earlier columns of U
        image = vector - weights @ (back.T @ vector)
        for _ in range(3):

            def products(x: np.ndarray, image=image, weights=weights) -> np.ndarray:
                x = centred(x)
                u = x @ image
                return np.concatenate([x.T @ u, [u @ u], (x @ weights).T @ u])

            found = _added(fit.blocks, fit.many, products, "<f8")
            back_image, square, along = found[:size], found[size], found[size + 1 :]
            image = image - weights @ along
            if np.linalg.norm(along) <= 1e-9 * np.sqrt(square) or square <= (_NOTHING * norm) ** 2:
                break
        alpha = np.sqrt(max(square - along @ along, 0.0))
        if alpha <= _NOTHING * norm:
            vector = np.zeros(size)
            continue
        column = (back_image - back @ along) / alpha
        weights, back = np.column_stack([weights, image / alpha]), np.column_stack([back, column])
        entries.append((back.shape[1] - 1, step, alpha))
        vector = _orthogonal(column, right)
    matrix = np.zeros((max(1, back.shape[1]), size))
    for row, column, value in entries:
        matrix[row, column] = value
    return right, matrix


def train(rows: DataFrame, settings: Settings = Settings()) -> Whitening | None:
    """Components by falling eigenvalue, at most as many as the covariance has rank.

    None if there are no vectors, or all are equal.
    """
    fit = fit_list(rows)
    if fit is None:
        return None
    centred = fit.centred()
    square = float(_added(fit.blocks, fit.many, lambda x: np.array([(centred(x) ** 2).sum()]), "<f8")[0])
    if square <= 0:
        return None
    right, matrix = bidiagonalise(fit, np.sqrt(square), settings.seed)
    _, deviations, turned = np.linalg.svd(matrix)
    kept = min(settings.components, int((deviations > _RANK * deviations[0]).sum()))
    directions = right @ turned[:kept].T / (deviations[:kept] / np.sqrt(fit.n))

    def moments(x: np.ndarray) -> np.ndarray:
        white = centred(x) @ directions
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    found = _added(fit.blocks, fit.many, moments, "<f8") / fit.n
    mean, second = found[:kept], found[kept:].reshape(kept, kept)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(kept)).max())
    return Whitening(fit, directions, deviations[:kept] ** 2 / square, error)


def _squares(base: np.ndarray, rest: np.ndarray, n: int) -> Callable[[np.ndarray], list[int | None]]:
    """Exact sums of (n * x - S)^2 by row; None if one needs more than 63 bits."""
    small = rest.astype(float).max(initial=0) < 2**62

    def run(x: np.ndarray) -> list[int | None]:
        x = x - base
        most = (int(np.abs(x).max(initial=0)) + 1) * n
        if small and x.shape[1] * most * most < 1 << 63:
            return ((n * x - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - rest) ** 2).sum(axis=1)
        return [value if value < 1 << 63 else None for value in exact]

    return run


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """For each row and component, the whitened value: ``vec_id``, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds null or non-finite entries are left out, and so are rows
    whose vector is not as long as most are (the longer length in a tie). Rows that repeat an id
    or a vector, and rows without an id, each have their own result; a vector counts once in
    the fit. There are as many components as the covariance has rank, 16 at most; without
    any (no rows, or equal vectors only) the result is empty. A ``deviation`` beyond 63 bits is null.
    """
    rows = grid(vectors, key, vector, settings)
    model = train(rows, settings)
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, directions, centred = model.fit.n, model.directions, model.fit.centred()
    squares = _squares(model.fit.base, model.fit.rest, n)
    explained, error = model.explained, model.identity_error
    count = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, _BLOCK_BYTES // (8 * len(directions)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                x = _matrix(part.column("x"), part.num_rows)
                row = pa.array(np.repeat(np.arange(part.num_rows), count))
                columns = [
                    part.column("id").take(row),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), part.num_rows)),
                    pa.array(np.full(len(row), n)),
                    pa.array(squares(x), pa.int64()).take(row),
                    pa.array((centred(x) @ directions).ravel()),
                    pa.array(np.tile(explained, part.num_rows)),
                    pa.array(np.full(len(row), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
