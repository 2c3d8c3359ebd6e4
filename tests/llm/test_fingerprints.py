"""SimHash groups, whitening and the filter audit against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from compare import compare, duck
from llm.helpers import DOCUMENTS, LOWER, SMALL, WORDS, rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import audit, simhash, whitening
from eventloom.llm import queries as corpus


def brute_fingerprint(text):
    words = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            root[find(b)] = find(a)
    out = []
    for n, (i, _) in enumerate(rows):
        known = [rows[m][0] for m in range(len(rows)) if find(m) == find(n) and rows[m][0] is not None]
        out.append((i, f"{prints[n]:016x}", min(known, default=None)))
    return sorted(out, key=repr)


def groups(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


@pytest.mark.parametrize("crowded", [1024, 1])
def test_groups(frame, odd, crowded):
    """With usual and with refined anchors."""
    texts = [*odd, "one", "a b c", "A B C", "a b c d"]
    got = simhash.near_copies(frame(texts), simhash.Settings(crowded=crowded))
    assert groups(got) == brute_groups(list(enumerate(texts)))


def test_groups_of_odd_ids(frame, odd):
    ids = [None if n % 9 == 0 else n // 2 for n in range(len(odd))]
    assert groups(simhash.near_copies(frame(odd, ids))) == brute_groups(list(zip(ids, odd, strict=True)))


def test_no_documents(frame):
    assert groups(simhash.near_copies(frame([]))) == []


def test_long_text_in_pieces(monkeypatch):
    draw = random.Random(3)
    text = "".join(draw.choice(["aé", "B ", "\n", "漢 ", "word  ", "x"]) for _ in range(3000))
    whole = brute_fingerprint(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "_PIECE", size)
        assert simhash.fingerprint(text.encode()) == whole


def test_code_covers():
    """Every syndrome has one pattern within the radius, so every block has one home."""
    code = simhash.CoveringCode(2)
    assert (np.diff(code.bounds[0]) == 1).all() and [len(p) for p in code.patterns] == [2048, 8855, 33649]
    f = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 200)
    rows, found = code.anchors(f, 2)
    anchors = [set(found[rows == n].tolist()) for n in range(len(f))]
    assert sum(map(len, anchors)) == len(found)
    homes = code.anchors(f, 0)[1]
    for n, a in enumerate(f.tolist()):
        for x, y in [(0, 1), (22, 23), (3, 40), (45, 46), (62, 63), (5, 5)]:
            b = np.uint64(a & (1 << 64) - 1) ^ np.uint64(1 << x) ^ np.uint64(1 << y)
            home = code.anchors(np.array([b], np.uint64).view(np.int64), 0)[1][0]
            assert int(home) in anchors[n] and int(homes[n]) in anchors[n]


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
@pytest.mark.parametrize("crowded", [1024, 2])
def test_all_links(spark, threshold, crowded):
    """Dense groups around few centres, whose anchors are crowded."""
    draw = random.Random(threshold)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = draw.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for _ in range(60)}
    signed = sorted(np.array(list(prints), np.uint64).view(np.int64).tolist())
    wanted = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= threshold}
    rows = spark.createDataFrame([(f,) for f in signed], "f long")
    found = simhash.linked(rows, simhash.Settings(threshold=threshold, crowded=crowded)).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


@pytest.mark.parametrize("crowded", [1024, 2])
def test_replicas_are_not_broadcast(spark, tmp_path, crowded):
    """Every fingerprint has about 61 replicas (and up to 65 words), which the planner does not know of."""
    spark.range(8).select(F.col("id").alias("f")).write.parquet(str(tmp_path / "prints"))
    pairs = simhash.linked(spark.read.parquet(str(tmp_path / "prints")), simhash.Settings(crowded=crowded))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin .* Inner", plan)
    assert pairs.count() == 28 - 4  # all pairs of three bits but the opposite ones


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType())])


def whitened(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, "n") for i, v in rows], VECTORS).repartition(3)
    return whitening.whiten(df, settings=whitening.Settings(**settings)).toPandas()


def check_whitening(spark, rows, **settings):
    got = whitened(spark, rows, **settings)
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(settings.get("components", 16), int((values > 1e-12 * values[0]).sum()))
    assert len(got) == count * len(good) and (got["n"] == n).all()
    assert (got["identity_error"] < 1e-8).all() and got["identity_error"].nunique() == 1
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, values[:count] / values.sum(), rtol=1e-8)
    deviation = {i: int(((n * row - sums) ** 2).sum()) for (i, _), row in zip(good, x, strict=True)}
    assert {(a, b) for a, b in zip(got["vec_id"], got["deviation"], strict=True)} == set(deviation.items())
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    wanted = (x - sums / n) @ vectors[:, :count] / np.sqrt(values[:count])
    for c in range(count):
        mine = table.loc[[i for i, _ in good], c + 1].to_numpy()
        assert np.allclose(mine, wanted[:, c], atol=1e-6) or np.allclose(mine, -wanted[:, c], atol=1e-6)


def test_whitening(spark):
    draw = np.random.default_rng(1)
    data = draw.normal(size=(400, 24)) * np.linspace(3, 0.2, 24)
    rows = [(n, v.tolist()) for n, v in enumerate(data)] + [(1000 + n, data[5].tolist()) for n in range(150)]
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [1.0] * 23 + [float("inf")]), (2004, [0.0] * 24)]
    check_whitening(spark, rows)


def test_whitening_of_low_rank(spark):
    """Fewer components than entries, constant entries, and fewer vectors than entries."""
    draw = np.random.default_rng(2)
    base = draw.integers(-4, 5, size=(200, 5)).astype(float)
    low = np.column_stack([base, base[:, :3] * 2, np.full((200, 2), 7.0)])
    check_whitening(spark, [(n, v.tolist()) for n, v in enumerate(low)])
    check_whitening(spark, [(n, v.tolist()) for n, v in enumerate(draw.normal(size=(6, 20)))])


def test_whitening_of_repeated_eigenvalues(spark):
    """All corners of a cube have equal deviations; a single sequence would find one of them."""
    rows = [(n, [float(b) for b in bits]) for n, bits in enumerate(itertools.product([-1, 1], repeat=6))]
    got = whitened(spark, rows)
    assert sorted(got["component"].unique()) == [1, 2, 3, 4, 5, 6] and np.allclose(got["explained"], 1 / 6)
    assert (got["identity_error"] < 1e-9).all()


def test_whitening_of_little(spark):
    """No rows, one vector, equal vectors, no entries: no components. Other lengths are left out."""
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, None)]):
        assert whitened(spark, rows).empty
    got = whitened(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [2.0, 2.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])])
    assert sorted(got["vec_id"].dropna().unique()) == [1, 2] and len(got) == 6
    far = whitened(spark, [(1, [3e38, 1.0]), (2, [-3e38, 5.0]), (3, [0.0, 0.0])])
    assert len(far) and far["deviation"].isna().any()


def test_deviations_are_exact():
    base, rest, n = np.array([0, 5]), np.array([3, 1], object), 1 << 31
    x = np.array([[7, 9], [-1, 5], [1 << 40, 0]])
    exact = [sum((n * (int(v) - int(b)) - r) ** 2 for v, b, r in zip(row, base, rest, strict=True)) for row in x]
    assert whitening._squares(base, rest, n)(x) == [e if e < 1 << 63 else None for e in exact]
    assert whitening._squares(base, rest, 3)(x[:2]) == [sum((3 * (int(v) - int(b)) - r) ** 2 for v, b, r in zip(row, base, rest, strict=True)) for row in x[:2]]


def brute_audit(rows, labels):
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    marks.pop(None, None)
    least = {}
    far = 1 << 63
    for i, text, _ in rows:
        least[text or ""] = min(least.get(text or "", far), far if i is None else i)
    found = []
    for i, text, lang in rows:
        t = text or ""
        words = WORDS.findall(t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": (far if i is None else i) > least[t],
        }
        found.append((lang or "", {x for x in fails if fails[x]}, *marks.get(i, (False, False))))
    out = []
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {f[0] for f in found}:
        own = [f[1:] for f in found if f[0] == part]
        removed = {}
        for order in orders:
            for s, x in enumerate(order):
                removed[order, x] = sum(x in fails and not fails & set(order[:s]) for fails, _, _ in own)
        for order in orders:
            for s, x in enumerate(order):
                before = set(order[:s])
                gone = [(good, toxic) for fails, good, toxic in own if x in fails and not fails & before]
                kept = sum(not fails & (before | {x}) for fails, _, _ in own)
                redundant = sum(x in fails and bool(fails & before) for fails, _, _ in own)
                unique = sum(fails == {x} for fails, _, _ in own)
                shapley = sum(removed[o, x] for o in orders)
                out.append((part, order, s + 1, kept, len(gone), redundant, unique, sum(g for g, _ in gone), sum(t for _, t in gone), shapley))
    return sorted(out)


def test_audit(spark, frame, odd):
    texts = [*odd, *["w" + str(n % 300) + " text" for n in range(20)], " ".join(f"w{n}" for n in range(300)), " ".join(f"w{n}" for n in range(300)), "a #"]
    ids = [None if n % 11 == 0 else n // 2 * 3 % 50 for n in range(len(texts))]
    labels = [(n, n % 2, (n // 2) % 2) for n in range(40)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, None), (999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(frame(texts, ids), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [(r[0], r[1], r[2]) for r in rows_of(texts, ids)]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_audit_of_many_parts(spark, monkeypatch):
    """More languages than a task holds sums for."""
    rows = [(n, f"text {n % 7}", f"l{n % 40}", None, 1, None, None, None, None) for n in range(120)]
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(audit, "_HELD", 3)
    got = audit.audit(spark.createDataFrame(rows, DOCUMENTS).repartition(4), marks)
    assert sorted(map(tuple, got.collect())) == brute_audit([r[:3] for r in rows], [])
    assert audit.audit(spark.createDataFrame([], DOCUMENTS), marks).collect() == []


def test_fields_do_not_overflow():
    """Sums of large numbers of equal and of different integers."""
    total = (1 << 40) * audit.packed(3) + 5 * audit.packed(1) + 7 * audit.packed(0)
    fields = audit.unpacked(total)
    at = audit.ORDERS.index("ABCDE") * 5
    assert fields[at].tolist() == [7, (1 << 40) + 5, 0, 0, 0] and fields[at + 1].tolist() == [7, 0, 1 << 40, 0, 0]


@pytest.mark.parametrize("name", ["op11_simhash_dedup", "op12_embedding_whitening", "op13_filter_audit"])
def test_queries(spark, name):
    assert compare(spark, duck(SMALL), SMALL, corpus.QUERIES[name], corpus.ORACLES.get(name)) is None
