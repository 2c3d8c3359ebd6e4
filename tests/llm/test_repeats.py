"""Suffix-array, phrase and line dedup against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from llm.helpers import LOWER, WORDS, sha

from eventloom.llm import blocks, lines, phrases, repeat_groups, suffixes


def brute_suffixes(rows, width=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + width] for _, b in data for s in range(len(b) - width + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                gone[s : s + width] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), len(b) - len(kept), spans, sha(kept)))
    return out


def brute_phrases(rows, width=20):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: (x[0] is not None, x[0])):
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), (i, s))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (i, s):
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def brute_lines(rows):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, ls in split:
        for line in ls:
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, ls in split:
        stay = []
        for line in ls:
            ids = held.get(key(line), ())
            known = [x for x in ids if x is not None]
            goes = len(ids) >= 5 and known and (i is None or i < max(known))
            if not goes:
                stay.append(line)
        out.append((i, len(ls), len(ls) - len(stay), sha("\n".join(stay))))
    return out


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


CASES = {
    "suffixes": (suffixes.suffix_digests, brute_suffixes, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
    "phrases": (phrases.phrase_digests, brute_phrases, ("doc_id", "n_words", "n_removed", "kept_sha256")),
    "lines": (lines.line_digests, brute_lines, ("doc_id", "n_lines", "n_dropped", "kept_sha256")),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_odd_texts(frame, odd, name):
    digests, brute, columns = CASES[name]
    assert collected(digests(frame(odd)), *columns) == sorted(brute(list(enumerate(odd))), key=repr)


@pytest.mark.parametrize("name", sorted(CASES))
def test_empty_table(frame, name):
    digests, _, columns = CASES[name]
    assert collected(digests(frame([])), *columns) == []


@pytest.mark.parametrize("name", sorted(CASES))
def test_missing_id(frame, odd, name):
    digests, brute, columns = CASES[name]
    ids = [None, *range(1, len(odd))]
    texts = [odd[-5], *odd[1:]]
    assert collected(digests(frame(texts, ids)), *columns) == sorted(brute(list(zip(ids, texts, strict=True))), key=repr)


def test_repeated_rows(frame, odd):
    """Equal rows are two places for byte strings, one document for phrases and lines."""
    twice = odd[5:6] + odd[-3:]
    ids = [0, 1, 2, 3]
    df = frame(twice + twice[-1:], [*ids, 3])
    removed = {tuple(r) for r in suffixes.suffix_digests(df).where("doc_id = 3").select("n_removed").collect()}
    assert removed == {(len(twice[-1].encode()),)}
    assert [r["n_removed"] for r in phrases.phrase_digests(df).where("doc_id = 3").collect()] == [0, 0]
    assert [r["n_dropped"] for r in lines.line_digests(df).where("doc_id = 3").collect()] == [0, 0]


def test_frequent_anchor(frame, monkeypatch):
    """Groups beyond the bound of one suffix array, and shards of several tasks, give the same rows."""
    monkeypatch.setattr(suffixes, "MEMBERS", 3)
    monkeypatch.setattr(suffixes, "SHARD_BLOCKS", 4)
    monkeypatch.setattr(phrases, "SHARD_BLOCKS", 4)
    passage = " ".join(f"word{n}" for n in range(60))
    texts = [f"begin{n} of {n * 7} {passage} end{n}" + f" more{n}" * (n % 5) for n in range(40)]
    rows = list(enumerate(texts))
    for name in ("suffixes", "phrases"):
        digests, brute, columns = CASES[name]
        assert collected(digests(frame(texts)), *columns) == sorted(brute(rows), key=repr)


def test_patterns_of_one_anchor_are_bounded(frame, monkeypatch):
    """A template with fields that recur in pairs: one anchor, and many patterns, which no task has all of."""
    monkeypatch.setattr(phrases, "SHARD_BLOCKS", 50)
    find = phrases._later_occurrences

    def bounded(patterns, texts):
        assert len(patterns) <= 200 and len(texts) <= 200
        return find(patterns, texts)

    monkeypatch.setattr(phrases, "_later_occurrences", bounded)
    fixed = [f"fixed{n} words of the same template" for n in range(4000)]
    least = [int(blocks.find_blocks(*phrases._symbols(next(phrases.slices(pa.array([t])))), blocks.Shape(6, 6)).h[0]) for t in fixed]
    template = fixed[int(np.argmin(least))]
    fields = lambda name, n: " ".join(f"{name}{n}x{k}" for k in range(8))
    texts = [f"{fields('a', n)} {fields('b', n // 2)} {template} {fields('c', n // 2)} {fields('d', n)}" for n in range(300)]
    texts += [f"{fields('e', n)} {fields('b', 0)} {template} {fields('c', 0)} {fields('f', n)}" for n in range(300, 400)]
    digests, brute, columns = CASES["phrases"]
    assert collected(digests(frame(texts)), *columns) == sorted(brute(list(enumerate(texts))), key=repr)


def test_long_sequences_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(blocks, "_PLACE_BITS", 10)
    draw = np.random.default_rng(0)
    symbols, bounds = draw.integers(97, 122, 5000).astype(np.uint8), np.array([0, 3000, 3100, 5000])
    found = blocks.find_blocks(symbols, bounds, suffixes.SHAPE)
    windows = sorted((r, lo + k) for r, lo, n in zip(found.row, found.lo, found.size, strict=True) for k in range(n))
    assert windows == [(r, s) for r in (0, 2) for s in range(bounds[r + 1] - bounds[r] - 199)]


def test_maximal_repeats_have_all_members():
    """Groups of one anchor: lengths left and right, and every member that has them."""
    texts = ["xxABCANCHORdefgh", "yxABCANCHORdefzz", "zzzBCANCHORdefgh", "qqqqqANCHORqqqqq"]
    place = 5
    left, right = [t[:place][::-1].encode() for t in texts], [t[place:].encode() for t in texts]
    found = {(b, a, tuple(sorted(g))) for b, a, g in suffixes.maximal_repeats(left, right, 6)}
    assert found == {(0, 6, (0, 1, 2, 3)), (2, 9, (0, 1, 2)), (4, 9, (0, 1)), (2, 11, (0, 2))}


def test_runs_hold_the_newest_numbers(spark, frame, odd):
    """Every batch adds its hashes once, with the documents of all batches so far."""
    long = lines.long_lines(frame(odd), 40, 5).cache()
    runs = lines.LineRuns(spark, fanout=2)
    for batch in range(5):
        runs.add(long.where(long["batch"] == batch))
        whole = long.where(long["batch"] <= batch).groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("max_doc"))
        assert {tuple(r) for r in runs.totals().collect()} == {tuple(r) for r in whole.collect()}
        again = lines.LineRuns.open(spark, runs.folder, fanout=2)
        assert (again.levels, again.batches) == (runs.levels, runs.batches)
    assert sum(len(level) for level in runs.levels) < 5


def test_later_call_reads_the_runs(spark, frame, odd):
    """New documents are judged with all earlier ones, though only the runs of those are read."""
    old, new = frame(odd).where("doc_id % 3 > 0"), frame(odd).where("doc_id % 3 = 0")
    runs = lines.LineRuns(spark)
    lines.repeated_positions(old, runs=runs)
    later = lines.LineRuns.open(spark, runs.folder)
    found = lines.repeated_positions(new, batches=1, runs=later).collect()
    whole = lines.repeated_positions(frame(odd)).where("doc_id % 3 = 0").collect()
    assert found and sorted(map(tuple, found)) == sorted(map(tuple, whole))
    assert later.batches == 5




def found_groups(frame, texts):
    """Groups by id: length and sorted occurrences."""
    groups = defaultdict(list)
    for row in repeat_groups.repeat_groups(frame(texts)).collect():
        groups[row["group"], row["length"]].append((row["doc_id"], row["start"]))
    return [(length, sorted(places)) for (_, length), places in groups.items()]


@pytest.mark.parametrize("members", [512, 2])
def test_groups_hold_all_occurrences(frame, odd, members, monkeypatch):
    """Of equal blocks, shared parts, and blocks of frequent anchors."""
    monkeypatch.setattr(suffixes, "MEMBERS", members)
    texts = odd[:30]
    data = [(t or "").encode() for t in texts]
    windows = defaultdict(list)
    for i, b in enumerate(data):
        for start in range(len(b) - 199):
            windows[b[start : start + 200]].append((i, start))
    groups = found_groups(frame, texts)
    held = defaultdict(set)
    for length, places in groups:
        assert len(places) > 1 and len({data[i][s : s + length] for i, s in places}) == 1
        assert all(s + length <= len(data[i]) for i, s in places)
        for shift in range(length - 199):
            held[places[0][0], places[0][1] + shift].add(tuple((i, s + shift) for i, s in places))
    for places in windows.values():
        if len(places) > 1:
            assert tuple(places) in held[places[0]]


def test_copies_are_one_group(frame):
    """Exact copies recur as a whole: one group as long as the text, with every copy."""
    rng = np.random.default_rng(5)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    copy, shared = text(864), text(500)
    texts = [copy, None, copy, text(300) + shared + text(90), "", copy, shared + text(50), text(400)]
    assert sorted(found_groups(frame, texts)) == [(500, [(3, 300), (6, 0)]), (864, [(0, 0), (2, 0), (5, 0)])]
    assert repeat_groups.repeat_groups(frame([])).collect() == []
