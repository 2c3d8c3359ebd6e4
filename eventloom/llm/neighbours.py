"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cells of random projections; a query visits its own bucket and
then perturbed ones, in the order of their estimated success: the sum of squared distances
from the query to the cell borders that a perturbation crosses. Candidates of all tables are
merged and ranked by their exact distance. How many buckets are visited is fitted on a
bounded sample of queries whose neighbours are known.

Equal vectors are one class: it is indexed once, and found classes are expanded to the few
members that can be among the nearest. The query set meets the vectors in blocks, which tasks
write with their probes to the shared folder: other tasks hold a share of the vectors and go
through the blocks. Only the fitting sample passes through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.arrays import mix
from eventloom.llm.shared_arrays import map_array, write_array
from eventloom.session import stage, staging_path

#: Queries of a block, and bucket keys of their probes.
BLOCK = 4096
BLOCK_KEYS = 2_000_000
#: Vectors looked up or compared at once, and vectors of a task.
BATCH = 2048
TASK = 8192


@dataclass(frozen=True)
class Settings:
    tables: int = 10
    hashes: int = 12
    #: Cell width in median distances to the k-th neighbour.
    width: float = 3.0
    #: Share of the sample's neighbours that the visited buckets must hold.
    recall: float = 0.96
    sample: int = 128
    most_probes: int = 1000
    seed: int = 11


@dataclass
class Index:
    """Projections (tables x dimensions x hashes), shifts, cell width, and buckets to visit a table."""

    projections: np.ndarray
    shifts: np.ndarray
    width: float
    probes: int

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return (vectors @ self.projections[table] + self.shifts[table]) / self.width

    def buckets(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return mix(np.floor(self.cells(vectors, table)).astype(np.int64) @ self.factors(table)).view(np.uint64)

    def factors(self, table: int) -> np.ndarray:
        """Odd numbers; a bucket's key is mixed from the sum of its cells times these."""
        places = np.arange(self.projections.shape[2], dtype=np.uint64) + np.uint64(1 + 1000 * table)
        return (mix(places) | np.uint64(1)).view(np.int64)


def perturbations(hashes: int, most: int) -> np.ndarray:
    """The first ``most`` sets of crossed borders, best first, as rows of 0 and 1.

    Column j stands for the j-th nearest of a query's ``2 * hashes`` cell borders. Its squared
    distance is taken as expected for a place in the cell that is uniform, so that one order
    serves all queries. Sets are made from the empty one by replacing or adding the next
    border; the two borders of one cell (columns j and 2 * hashes - 1 - j) exclude each other.
    """
    count = 2 * hashes
    j = np.arange(1, hashes + 1)
    near = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    back = hashes - np.arange(hashes)
    far = 1 - back / (hashes + 1) + back * (back + 1) / (4 * (hashes + 1) * (hashes + 2))
    cost = np.concatenate([near, far])
    found = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < most:
        value, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if not any(count - 1 - i in chosen for i in chosen):
            found.append(chosen)
        if last + 1 < count:
            heapq.heappush(heap, (value - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (value + cost[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(found), count), np.int64)
    for row, chosen in enumerate(found):
        out[row, list(chosen)] = 1
    return out


def probe_keys(index: Index, queries: np.ndarray) -> np.ndarray:
    """Keys of the buckets to visit: queries x tables x probes, best first."""
    hashes = index.projections.shape[2]
    sets = perturbations(hashes, index.probes)
    out = np.empty((len(queries), len(index.projections), len(sets)), np.uint64)
    for table in range(len(index.projections)):
        cells = index.cells(queries, table)
        floors = np.floor(cells).astype(np.int64)
        place, factors = cells - floors, index.factors(table)
        order = np.argsort(np.concatenate([place, 1 - place], axis=1), axis=1, kind="stable")
        steps = np.concatenate([-factors, factors])[order]
        out[:, table] = mix((floors @ factors)[:, None] + steps @ sets.T).view(np.uint64)
    return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _candidates(index: Index, rows: np.ndarray, visits: list, queries: int) -> np.ndarray:
    """Queries x rows: whether a query visits a bucket of the row in any table."""
    held = np.zeros((queries, len(rows)), bool)
    for table, (keys, query) in enumerate(visits):
        own = index.buckets(rows, table)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        hits = high - low
        at = np.repeat(np.arange(len(rows)), hits)
        held[query[np.repeat(low, hits) + np.arange(len(at)) - np.repeat(np.cumsum(hits) - hits, hits)], at] = True
    return held


def _nearest(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` nearest, ties to the smaller id."""
    if len(scores) > count:
        places = np.flatnonzero(scores <= np.partition(scores, count - 1)[count - 1])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], scores[places]))][:count]


def _write_blocks(queries: DataFrame, index: Index | None) -> tuple[str, int]:
    """Folder and number of the blocks of the queries; tasks write them, by hash of the class.

    A block's arrays are its classes, their vectors, and for each table the keys of all buckets to
    visit, in order, with the place of the query that visits each.
    """
    folder = staging_path(queries.sparkSession, "query-blocks")
    most = max(1, min(BLOCK, BLOCK_KEYS // (index.probes * len(index.projections)))) if index else BLOCK
    blocks = 1 + queries.count() // most

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        block = table.column("block")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        write_array(folder, f"class-{block}", table.column("class").to_numpy())
        write_array(folder, f"vector-{block}", vectors)
        if index is not None:
            keys = probe_keys(index, vectors.astype(np.float64)).transpose(1, 0, 2)
            visitors = np.empty(keys.shape, np.int32)
            for table_keys, table_visitors in zip(keys, visitors, strict=True):
                order = np.argsort(table_keys, axis=None, kind="stable")
                table_visitors[:] = (order // keys.shape[2]).reshape(table_visitors.shape)
                table_keys[:] = table_keys.ravel()[order].reshape(table_keys.shape)
            write_array(folder, f"keys-{block}", keys.reshape(len(keys), -1))
            write_array(folder, f"visitors-{block}", visitors.reshape(len(keys), -1))
        return pa.table({"block": pa.array([block], pa.int64()), "rows": pa.array([len(table)], pa.int64())})

    rows = queries.select(F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("block"), "class", "vector")
    stage(rows.groupBy("block").applyInArrow(write, "block long, rows long"), "block-sizes")
    return folder, blocks


def _search(classes: DataFrame, queries: DataFrame, index: Index | None, count: int) -> DataFrame:
    """``query``, ``class``, ``score``, ``vector`` of the ``count`` nearest classes found for each query.

    Each task holds its own vectors and goes through all blocks of queries, mapped from the shared
    folder. Without an index every vector is a candidate.
    """
    folder, blocks = _write_blocks(queries, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not whole:
            return
        own = whole.column("class").to_numpy()
        stored = whole.column("vector").combine_chunks()
        rows = _matrix(stored, len(stored[0]))
        for block in range(blocks):
            ids = map_array(folder, f"class-{block}")
            if ids is None:  # no class has this hash
                continue
            queries = map_array(folder, f"vector-{block}").astype(np.float64)
            asked, chosen, scores = [], [], []
            visits = None
            if index is not None:
                visits = list(zip(map_array(folder, f"keys-{block}"), map_array(folder, f"visitors-{block}"), strict=True))
            held = None
            if visits is not None:
                held = np.concatenate([_candidates(index, rows[i : i + BATCH], visits, len(queries)) for i in range(0, len(rows), BATCH)], axis=1)
            for at in range(len(queries)) if held is None else np.flatnonzero(held.any(1)):
                places = np.arange(len(rows)) if held is None else np.flatnonzero(held[at])
                distances = np.concatenate([((rows[places[i : i + BATCH]] - queries[at]) ** 2).sum(1) for i in range(0, len(places), BATCH)])
                distances = np.sqrt(distances)
                best = _nearest(distances, own[places], count)
                asked.append(np.full(len(best), ids[at]))
                chosen.append(places[best])
                scores.append(distances[best])
            if chosen:
                places = np.concatenate(chosen)
                columns = [pa.array(np.concatenate(asked)), pa.array(own[places]), pa.array(np.concatenate(scores)), stored.take(pa.array(places))]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "class", "score", "vector"])

    tasks = 1 + classes.count() // TASK
    found = classes.select("class", "vector").repartition(tasks, "class").mapInArrow(run, "query long, class long, score double, vector array<float>")
    return _best(found, "query", ["score", "class"], count).drop("rank")


def _best(rows: DataFrame, by: str, order: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of each key; tasks drop the others before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= count)


def valid_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``vector``, and 128 bits of hash (``c1``, ``c2``) of the vectors that take part.

    Not those null, zero, of another length than most (the longer one in a tie), holding null or non-finite
    components, or without an id. Rows that repeat an id and its vector count once.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("vector") == (usual["size"] if usual else 0)).select("id", "vector", F.xxhash64("vector").alias("c1"), F.xxhash64(F.lit(1), F.col("vector")).alias("c2"))


def fit(classes: DataFrame, sample: DataFrame, count: int, settings: Settings) -> Index | None:
    """An index whose probes find the wanted share of the sample's neighbours; None if they cannot."""
    rows = sample.toPandas()
    if not len(rows):
        return None
    queries = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    found = _search(classes, sample, None, count + 1).toPandas()
    found = found[found["query"] != found["class"]]
    if not len(found):
        return None
    random = np.random.default_rng(settings.seed)
    size = queries.shape[1]
    far = float(found.groupby("query")["score"].max().median())
    width = settings.width * far if far > 0 else 1.0
    projections = random.normal(size=(settings.tables, size, settings.hashes))
    index = Index(projections, random.uniform(0, width, (settings.tables, settings.hashes)), width, settings.most_probes)
    place_of = {key: i for i, key in enumerate(rows["class"])}
    own = found["query"].map(place_of).to_numpy()
    neighbours = np.stack(found["vector"].to_numpy()).astype(np.float64)
    first = np.full(len(found), np.iinfo(np.int64).max)
    probes = probe_keys(index, queries)
    for table in range(len(projections)):
        same = probes[own, table] == index.buckets(neighbours, table)[:, None]
        first = np.minimum(first, np.where(same.any(1), same.argmax(1), first))
    needed = np.sort(first)[min(len(first) - 1, int(np.ceil(settings.recall * len(first))) - 1)]
    if needed >= settings.most_probes:
        return None
    index.probes = int(needed) + 1
    return index


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``, ``probes`` of the ``k`` nearest found to each query.

    ``is_query`` is a condition on ``id``. Every other row is a candidate. Distances are
    Euclidean in double precision, ties go to the smaller id. A query that finds fewer than
    ``k`` rows by its buckets, though there are more, is compared with all classes, and so are all
    queries if the sample needs too many buckets; ``probes`` (buckets visited in each table) is null then.
    """
    valid = valid_vectors(vectors, key, vector)
    own = ["c1", "c2"]
    classes = stage(valid.groupBy(*own).agg(F.min("id").alias("class"), F.min_by("vector", "id").alias("vector")), "vector-classes")
    ids = valid.select(*own, "id").distinct()
    ranked = ids.withColumn("rank", F.row_number().over(W.partitionBy(*own).orderBy("id"))).where(F.col("rank") <= k + 1)
    total = classes.count()
    names = classes.select(*own, "class")
    members = stage(ranked.join(names, own).select("class", "id"), "class-members")
    asked = stage(ids.where(is_query).join(names, own).select("class", "id"), "queries")
    query_classes = stage(classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", "vector"), "query-classes")
    sample = stage(query_classes.orderBy(F.xxhash64("class", F.lit(settings.seed))).limit(settings.sample), "query-sample")
    index = fit(classes, sample, k, settings)
    found = _found(classes, query_classes, index, k + 1)
    if index is not None:
        enough = found.groupBy("query").count().where(F.col("count") >= min(k + 1, total)).select(F.col("query").alias("class"))
        short = stage(query_classes.join(enough, "class", "left_anti"), "short-queries")
        if not short.isEmpty():
            others = found.join(short.select(F.col("class").alias("query")), "query", "left_anti")
            found = others.unionByName(_found(classes, short, None, k + 1))
    rows = found.join(members, "class").select(F.col("query").alias("class"), "id", "score", "probes")
    pairs = asked.select("class", F.col("id").alias("query_id")).join(rows, "class").where(F.col("query_id") != F.col("id"))
    best = _best(pairs.select("query_id", "score", F.col("id").alias("vec_id"), "probes"), "query_id", ["score", "vec_id"], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "probes")


def _found(classes: DataFrame, queries: DataFrame, index: Index | None, count: int) -> DataFrame:
    """The nearest classes of each query, with the buckets visited in a table; written once."""
    probes = F.lit(index.probes if index else None).cast("int").alias("probes")
    return stage(_search(classes, queries, index, count).select("query", "class", "score", probes), "found-classes")
