"""Language model, language of words, and quality rules."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import LOWER, SMALL, WORDS

from eventloom.llm import language_id, language_model, quality
from eventloom.llm import queries as corpus
from eventloom.llm.arrays import slices
from eventloom.session import staging_root


def tokens(text):
    return [*WORDS.findall((text or "").translate(LOWER)), None]


class Brute:
    """The same model with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        counts = Counter()
        self.plain = Counter()
        for text in texts:
            words = tokens(text)
            self.plain.update(words)
            padded = ["<s>"] * (order - 1) + words
            counts.update(tuple(padded[i : i + order]) for i in range(len(words)))
        self.values = {order: counts}
        for level in range(order - 1, 0, -1):
            self.values[level] = Counter()
            for gram, value in self.values[level + 1].items():
                self.values[level][gram[1:]] += value if gram[1] == "<s>" else 1

    def discount(self, level, value):
        n = Counter(self.values[level].values())
        if not all(n[i] for i in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5][min(value, 3)]
        y = n[1] / (n[1] + 2 * n[2])
        found = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        i = min(value, 3)
        return min(found[i], i) if found[i] > 0 or i == 0 else [0, 0.5, 1.0, 1.5][i]

    def chance(self, gram):
        level = len(gram)
        follows = {g: v for g, v in self.values[level].items() if g[:-1] == gram[:-1]}
        total = sum(follows.values())
        below = self.chance(gram[1:]) if level > 1 else 1 / (len(self.plain) + 1)
        if not total:
            return below
        value = follows.get(gram, 0)
        rest = sum(self.discount(level, v) for v in follows.values()) / total
        return (value - self.discount(level, value)) / total + rest * below

    def score(self, text):
        words = tokens(text)
        padded = ["<s>"] * (self.order - 1) + words
        return sum(math.log10(self.chance(tuple(padded[i : i + self.order]))) for i in range(len(words)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_against_dictionaries(frame, odd, order, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_BYTES", 2000)
    known, new = odd[:22] + odd[-4:], [None, "", "never seen", odd[12], odd[-1] + " Unseen"]
    brute = Brute(known, order)
    model = language_model.train(frame(known), order)
    total, distinct = sum(brute.plain.values()), len(brute.plain)
    assert (model.tokens, model.words) == (total, distinct)
    for row in language_model.score(frame(new), model, ["doc_id"]).collect():
        words = tokens(new[row["doc_id"]])
        assert row["n_tokens"] == len(words) and row["train_tokens"] == total
        assert row["n_known"] == sum(w in brute.plain for w in words)
        assert row["base_score"] == pytest.approx(sum(math.log10((brute.plain[w] + 1) / (total + distinct + 1)) for w in words))
        assert row["score"] == pytest.approx(brute.score(new[row["doc_id"]]))
        assert row["perplexity"] == pytest.approx(10 ** (-row["score"] / len(words)))


def test_starts_keep_their_counts(frame):
    """A first word's chance after the start mark comes from all texts, not from distinct neighbours."""
    known = ["aa bb cc"] * 300 + ["dd bb cc", "ee aa dd"] * 2
    brute, model = Brute(known, 3), language_model.train(frame(known))
    assert brute.values[2][("<s>", "aa")] == 300
    for row in language_model.score(frame(["aa", "dd", "ee bb", "bb"]), model, ["doc_id"]).collect():
        assert row["score"] == pytest.approx(brute.score(["aa", "dd", "ee bb", "bb"][row["doc_id"]]))


def test_model_of_nothing(frame):
    model = language_model.train(frame([]))
    rows = language_model.score(frame(["a b", None]), model, ["doc_id"]).collect()
    assert [(r["n_known"], r["base_score"], r["score"]) for r in rows] == [(0, 0.0, 0.0)] * 2
    assert language_model.score(frame([]), model, ["doc_id"]).collect() == []


def test_model_sums_to_one(frame, odd):
    known = odd[11:30]
    model = language_model.train(frame(known), 2)
    words = sorted({w for t in known for w in tokens(t) if w})
    chances = language_model.score(frame([f"{words[3]} {w}" for w in words]), model, ["doc_id"]).toPandas()
    first = language_model.score(frame([words[3]]), model, ["doc_id"]).first()["score"]
    brute = Brute(known, 2)
    pairs = [10 ** (brute.score(f"{words[3]} {w}") - math.log10(brute.chance((w, None))) - math.log10(brute.chance(("<s>", words[3])))) for w in words]
    end, unknown = brute.chance((words[3], None)), brute.chance((words[3], "?"))
    assert sum(pairs) + end + unknown == pytest.approx(1)
    assert first == pytest.approx(math.log10(brute.chance(("<s>", words[3])) * end)) and len(chances) == len(words)


def test_model_beats_the_base(spark):
    held = corpus.op3_language_model(spark, SMALL).where("held_out").toPandas()
    assert held["score"].sum() > held["base_score"].sum()
    assert all((zlib.crc32(str(i).encode()) % 7 == 2) for i in held["doc_id"])


def test_registered_model_has_trigrams(spark):
    """The query's scores are those of order 3, and not those of order 2."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    known, split = documents.where(language_model.remainder(7) != 2), language_model.remainder(7) == 2
    found = corpus.op3_language_model(spark, SMALL).toPandas().sort_values("doc_id")
    for order in (2, 3):
        wanted = language_model.score(documents, language_model.train(known, order), ["doc_id", split.alias("held_out")]).toPandas().sort_values("doc_id")
        assert np.allclose(found["score"], wanted["score"]) == (order == 3)


def test_model_takes_little_disk(spark):
    """Everything that training leaves on disk, for each token: numbered words and packed keys, not whole hashes."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    place = Path(staging_root(spark)) / "eventloom"
    before = set(place.glob("*"))
    model = language_model.train(documents)
    left = sum(f.stat().st_size for new in set(place.glob("*")) - before for f in new.rglob("*") if f.is_file())
    assert left < 25 * model.tokens


@pytest.mark.parametrize("shards", [1, 7, 70_000])
def test_entries_are_found_again(tmp_path, shards):
    """Frequent and rare rows of numbers, large ones, and keys at the ends of the shards; others give zeros."""
    draw = np.random.default_rng(shards)
    edges = [(s << 64) // shards + d for s in range(min(shards, 8) + 1) for d in (-1, 0, 1)]
    keys = np.unique(np.concatenate([draw.integers(0, 1 << 64, 30_000, np.uint64), np.array([e for e in edges if 0 <= e < 1 << 64], np.uint64)]))
    keys = np.unique(np.concatenate([keys, keys[:4000] ^ np.uint64(1), keys[:2000] ^ np.uint64(512)]))
    keys, others = keys[::2], keys[1::2]
    numbers = draw.integers(0, 40, (5, len(keys))) ** draw.integers(1, 7, (5, len(keys)))
    for shard, own in language_model._shards(keys, shards):
        language_model._write_entries(str(tmp_path), f"order-2-{shard}", keys[own], list(numbers[:, own]), shard, shards)
    lookup, order = language_model.Lookup(str(tmp_path), shards), draw.permutation(len(keys))
    assert (lookup.find(2, keys[order], 5) == numbers.T[order]).all()
    assert not lookup.find(2, others, 5).any()


def test_marginals_are_exact():
    draw = np.random.default_rng(0)
    model = language_id.Model(["a", "b", "c"], None, draw.normal(size=(3, 3)), draw.normal(size=3), None)
    emissions, bounds = draw.normal(size=(400, 3)).astype(np.float32), np.array([0, 1, 1, 130, 258, 400])
    got = language_id.marginals(model, emissions, bounds)
    step, weights = np.exp(model.transitions), np.exp(emissions.astype(np.float64))
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if first == last:
            continue
        alpha, beta = [np.exp(model.begin) * weights[first]], [np.ones(3)]
        for t in range(first + 1, last):
            alpha.append((alpha[-1] / alpha[-1].sum()) @ step * weights[t])
        for t in range(last - 1, first, -1):
            beta.append(step @ (weights[t] * beta[-1] / beta[-1].sum()))
        both = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(both / both.sum(1, keepdims=True), got[first:last])


def test_languages_of_held_out_documents(spark):
    got = corpus.op8_language_id(spark, SMALL)
    rows = got.join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows["held_out"] & rows["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert rows["score"].between(0, 1).all()


def test_odd_texts_have_a_language(spark, frame, odd):
    learned = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(learned)
    texts = [None, "", "  ", "123 456 !!", *odd]
    rows = {r["doc_id"]: r for r in language_id.predict(frame(texts), model, ["doc_id"]).collect()}
    assert [rows[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and rows[0]["score"] == 0
    assert {rows[4 + i]["lang_pred"] for i, t in enumerate(odd) if re.search("[a-z]", t or "")} <= set(model.labels)
    assert language_id.predict(frame([]), model, ["doc_id"]).collect() == []
    nothing = language_id.train(learned.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(frame(odd), nothing, ["doc_id"]).collect()} == {"und"}


def test_switching_text_has_both_languages(spark):
    learned = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(learned)
    halves = {r["lang"]: r["text"] for r in learned.where("lang in ('de', 'en') AND n_chars > 1500 AND n_chars < 3000").orderBy("doc_id").collect()}
    part = next(slices(pa.array([halves["de"] + " " + halves["en"]])))
    shares = dict(zip(model.labels, language_id.text_shares(model, part)[0], strict=True))
    assert shares["de"] > 0.25 and shares["en"] > 0.25


def test_runs_show_where_a_text_switches(spark, frame):
    learned = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(learned)
    halves = {r["lang"]: r["text"].split()[:120] for r in learned.where("lang in ('de', 'en') AND n_chars > 1500 AND n_chars < 3000").orderBy("doc_id").collect()}
    texts = [" ".join(halves["de"] + halves["en"]), None, "123 456", " ".join(halves["en"])]
    rows = {r["doc_id"]: r["runs"] for r in language_id.predict(frame(texts), model, ["doc_id"]).collect()}
    assert rows[1] == rows[2] == []
    for row, size in ((0, 240), (3, 120)):
        assert [r["start"] for r in rows[row]] == [0, *[r["end"] for r in rows[row]][:-1]] and rows[row][-1]["end"] == size
        assert all(a["lang"] != b["lang"] for a, b in zip(rows[row], rows[row][1:], strict=False))
        assert all(1 / len(model.labels) <= r["probability"] <= 1 + 1e-9 for r in rows[row])
    words = [r["lang"] for r in rows[0] for _ in range(r["start"], r["end"])]
    wrong = sum(a != b for a, b in zip(words, ["de"] * 120 + ["en"] * 120, strict=True))
    assert wrong < 24 and words[:110].count("de") > 99 and words[130:].count("en") > 99


def brute_statistics(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if WORDS.search(line)]
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def test_statistics(frame, odd, spark):
    texts = [*odd, "a # b|c <x> &\n a\na\n a\n\n\n a", "x y z x y z"]
    statistics = quality.rule_statistics(frame(texts)).cache()
    model = quality.fit(statistics, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    got = {r["doc_id"]: tuple(r[c] for c in (*quality.COUNTS, "base_failed")) for r in quality.judge(statistics, model, ("doc_id",)).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}
    assert quality.rule_statistics(frame([])).collect() == []


def test_forest_separates_labelled_rows(spark):
    rows = corpus.op9_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    open_rows = rows[~rows["base_failed"]]
    assert open_rows[open_rows["quality"] == 1]["kept"].mean() > 0.98
    assert open_rows[open_rows["quality"] == 0]["kept"].mean() < 0.3
    assert not rows[rows["base_failed"]]["kept"].any()


def test_forest_sees_repeated_short_lines(spark, frame):
    """Listings of usual words, in which lines recur but windows of 3 words seldom do."""
    draw = np.random.default_rng(3)
    usual = ["".join(draw.choice(list("abcdefgh"), draw.integers(3, 8))) for _ in range(300)]
    lines = lambda words, width: "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
    texts = [lines(list(draw.choice(usual, 120)), 10) for _ in range(300)]
    texts += [lines(list(draw.choice(draw.choice(usual, 20), 120)), 1) for _ in range(24)]
    statistics = quality.rule_statistics(frame(texts)).cache()
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, len(texts), 2)], "doc_id long, quality int")
    judged = quality.judge(statistics, quality.fit(statistics, labels), ("doc_id",)).toPandas()
    assert not judged["base_failed"].any()
    listing = judged["doc_id"] >= 300
    assert not judged[listing]["kept"].any() and judged[~listing]["kept"].mean() > 0.98


def test_without_labels_the_forest_rejects_nothing(spark, frame, odd):
    statistics = quality.rule_statistics(frame(odd))
    for labels in ([], [(1, None)], [(11, 1)]):
        model = quality.fit(statistics, spark.createDataFrame(labels, "doc_id long, quality int"))
        judged = quality.judge(statistics, model, ("doc_id",))
        assert judged.where("kept = base_failed").count() == 0
    empty = quality.fit(statistics.where("false"), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.judge(statistics, empty, ("doc_id",)).count() == len(odd)


def test_path_lengths():
    """A row far from all others is separated first."""
    draw = np.random.default_rng(0)
    rows = np.vstack([draw.normal(size=(500, 4)), [[9, 9, 9, 9]]])
    scores = quality.grow_forest(rows, 50, 128, 1).scores(rows)
    assert scores.argmax() == 500


def test_the_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    """Rows without ids, with one id, or all equal: some are learned from, and never more than twice the wanted number."""
    seen = []
    monkeypatch.setattr(language_id, "fit_model", lambda texts, labels, seed=0: seen.append(len(texts)))
    for ids, texts in ((None, 2000), (7, 2000), (None, 1)):
        rows = [(ids, f"text {n % texts}", "en") for n in range(2000)]
        language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=50)
    assert all(0 < n <= 100 for n in seen[:2]) and seen[2] <= 100


def test_good_documents_pass_one_worker(spark):
    """Texts that are kept go through one map, with the verdicts of statistics and forest in turn; an earlier model is let go."""
    from eventloom.llm import arrays, stages
    from eventloom.session import stage

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = stages.keep_good(spark, docs, "/root/testdata/sf0.001")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    statistics = stage(quality.rule_statistics(docs), "statistics")
    model = quality.fit(statistics, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    wanted = quality.judge(statistics, model, ("doc_id",)).where("kept").select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in wanted.collect())
    assert arrays.held(("a",), lambda: 1) == arrays.held(("a",), lambda: 2) == 1
    arrays.let_go()
    assert arrays.held(("a",), lambda: 3) == 3
