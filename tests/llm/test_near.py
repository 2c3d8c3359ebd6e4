"""Near duplicates and nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import LOWER, WORDS
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import near_duplicates, neighbours, shingles
from eventloom.llm.arrays import slices


def shingle_set(text, size=5):
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows):
    """Over rows, so that repeated ids are judged by their own texts."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                root[find(a)] = find(b)
    out = []
    for n, (i, _) in enumerate(rows):
        group = [rows[m][0] for m in range(len(rows)) if find(m) == find(n)]
        known = [x for x in group if x is not None]
        least = min(known) if known else None
        out.append((i, len(sets[n]), least, i == least))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_odd_texts(frame, odd):
    assert found(near_duplicates.near_duplicates(frame(odd))) == brute_components(list(enumerate(odd)))


def test_missing_and_repeated_ids(frame, odd):
    ids = [None if n % 9 == 0 else n // 2 for n in range(len(odd))]
    assert found(near_duplicates.near_duplicates(frame(odd, ids))) == brute_components(list(zip(ids, odd, strict=True)))


def test_empty_table(frame):
    assert found(near_duplicates.near_duplicates(frame([]))) == []


def test_copies_of_copies(frame):
    """A chain that only neighbours link, and a star whose copies are not similar to each other."""
    draw = np.random.default_rng(5)
    word = lambda: "w" + str(draw.integers(10**9))
    chain = [[word() for _ in range(100)]]
    for _ in range(15):
        chain.append(chain[-1][6:] + [word() for _ in range(6)])
    base = [word() for _ in range(150)]
    star = []
    for _ in range(30):
        copy = list(base)
        for place in draw.choice(150, draw.integers(1, 6), replace=False):
            copy[place] = word()
        star.append(copy)
    texts = [" ".join(w) for w in [*reversed(chain), *star, base]]
    assert found(near_duplicates.near_duplicates(frame(texts))) == brute_components(list(enumerate(texts)))


def test_signatures_estimate_similarity():
    """Circulant coordinates agree as often as the sets are similar."""
    draw = np.random.default_rng(2)
    values = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    left, right = np.sort(values[:2000]), np.sort(values[1000:])
    sets = shingles.Sets(np.concatenate([left, right]), np.array([0, 2000, 4000]))
    signature = shingles.signatures(sets, 2000)
    assert abs((signature[0] == signature[1]).mean() - 1 / 3) < 0.04


def test_components_of_long_paths(spark):
    ends = [(n, n + 1) for n in range(0, 70)] + [(100, 101), (205, 200), (203, 200), (205, 203)]
    rows = [((a, 0, 0), (b, 0, 0)) for a, b in ends]
    node = T.StructType([T.StructField(n, T.LongType()) for n in ("d", "s1", "s2")])
    links = spark.createDataFrame(rows, T.StructType([T.StructField("a", node), T.StructField("b", node)]))
    got = {r["node"]["d"]: r["root"]["d"] for r in near_duplicates.components(links).collect()}
    expected = {n: 0 for n in range(1, 71)} | {101: 100, 205: 200, 203: 200}
    assert {k: v for k, v in got.items() if k != v} == expected


def test_shingles_of_slices(odd):
    part = next(slices(pa.array(odd, pa.string()), 1 << 30))
    sets = shingles.shingle_sets(part)
    assert [len(shingle_set(t)) for t in odd] == np.diff(sets.bounds).tolist()


VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("class", T.StringType())]
)


def brute_neighbours(rows, k=10):
    lengths = [len(v) for _, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and _ is not None]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    ids, matrix = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(np.float64).reshape(len(good), -1)
    out = {}
    for at, query in enumerate(ids):
        if query % 100 == 0:
            scores = np.sqrt(((matrix - matrix[at]) ** 2).sum(1))
            order = [i for i in np.lexsort((ids, scores)) if i != at][:k]
            out[int(query)] = [(int(ids[i]), scores[i]) for i in order]
    return out


def neighbours_of(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS)
    got = {}
    for row in neighbours.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert row["rank"] == len(got[row["query_id"]])
    return got


def close(got, wanted):
    assert got.keys() == {q for q, w in wanted.items() if w}
    for query, rows in got.items():
        assert [i for i, _ in rows] == [i for i, _ in wanted[query]]
        assert np.allclose([s for _, s in rows], [s for _, s in wanted[query]])


def test_odd_vectors(spark):
    """Few vectors, many of them equal: all are found, with ties to the smaller id."""
    draw = np.random.default_rng(4)
    vector = lambda: draw.normal(size=8).astype(np.float32).tolist()
    same = vector()
    rows = [(n, same if n % 7 == 0 else vector()) for n in range(0, 301, 5)]
    rows += [(400, None), (500, [0.0] * 8), (600, [float("nan")] * 8), (700, [None] * 8), (800, [1.0]), (None, vector()), (900, [float("inf")] * 8), (0, same)]
    close(neighbours_of(spark, rows), brute_neighbours(rows))


def test_a_malformed_longer_vector(spark):
    draw = np.random.default_rng(6)
    rows = [(n, draw.normal(size=4).astype(np.float32).tolist()) for n in range(0, 300)] + [(1000, [1.0] * 5)]
    got = neighbours_of(spark, rows)
    assert sorted(got) == [0, 100, 200] and all(len(found) == 10 and 1000 not in dict(found) for found in got.values())


def test_no_or_one_vector(spark):
    assert neighbours_of(spark, []) == {}
    assert neighbours_of(spark, [(100, [1.0, 2.0])]) == {}


def test_recall(spark):
    draw = np.random.default_rng(7)
    rows = [(n, draw.normal(size=32).astype(np.float32).tolist()) for n in range(4000)]
    got, wanted = neighbours_of(spark, rows), brute_neighbours(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * sum(map(len, wanted.values()))


def test_many_blocks(spark, monkeypatch):
    """Blocks of few queries, tasks of few vectors, and a crowd in one bucket: the same rows as one block gives."""
    draw = np.random.default_rng(9)
    middle = draw.normal(size=16)
    near = lambda n: middle + draw.normal(size=16) * 1e-3 if n % 3 == 0 else draw.normal(size=16)
    rows = [(n * 10, near(n).astype(np.float32).tolist()) for n in range(600)]
    whole = neighbours_of(spark, rows)
    for name, value in (("BLOCK", 7), ("BATCH", 50), ("TASK", 100)):
        monkeypatch.setattr(neighbours, name, value)
    assert neighbours_of(spark, rows) == whole
    wanted = brute_neighbours(rows)
    hits = sum(len({i for i, _ in whole[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert whole.keys() == wanted.keys() and hits >= 0.9 * 10 * len(wanted)


def test_the_way_taken(spark):
    """``probes`` tells a search by buckets from a comparison with all."""
    draw = np.random.default_rng(10)
    rows = [(n, draw.normal(size=8).astype(np.float32).tolist(), 0, "x") for n in range(500)]
    df = spark.createDataFrame(rows, VECTORS)
    few = neighbours.search(df, F.col("id") % 100 == 0, settings=neighbours.Settings(most_probes=1, hashes=20, width=0.2))
    assert {r["probes"] for r in few.collect()} == {None}
    many = neighbours.search(df, F.col("id") % 100 == 0).where("probes IS NOT NULL")
    assert many.count() > 0


@pytest.mark.parametrize("hashes", [1, 3, 6])
def test_perturbations(hashes):
    """All sets without both borders of a cell, each once, in order of expected cost."""
    sets = neighbours.perturbations(hashes, 10**6)
    assert len(sets) == 3**hashes == len({tuple(s) for s in sets})
    assert not (sets[:, :hashes] & sets[:, hashes:][:, ::-1]).any()
