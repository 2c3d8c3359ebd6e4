"""Encoding, mixing, the registered queries and the pipeline."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from compare import compare, duck
from llm.helpers import SMALL, sha

import __spark_entry__ as contract
import corpus_pipeline
from eventloom.llm import bpe, lines, mixing, near_duplicates, stages
from eventloom.llm import queries as corpus

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    tokens = bpe.read_ranks(PATH)
    return bpe.Vocabulary(tokens, bpe.find_halves(tokens), public_tokenizers.PATTERN)


PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "漢", "😀", "12", "!", "...", "'s", "'", "ß", "̀", "　", "<|endoftext|>"]


def test_encoding_is_the_librarys(vocabulary, library):
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30)))
        assert vocabulary.encode(text).tolist() == library.encode_ordinary(text)
    for text in ("a" * 5000, "ab" * 3000, " " * 3000, "!?" * 2000, "é" * 999):
        assert vocabulary.encode(text).tolist() == library.encode_ordinary(text)


def test_every_prefix_has_its_last_token(vocabulary, library):
    for word in ("unbelievably", "aaaaaaaaaaaa", "Donaudampfschiff", "éèêë"):
        last = []
        data = word.encode().decode("latin-1")
        vocabulary.extend(last, data)
        for end in range(1, len(data) + 1):
            assert last[end - 1] == library._encode_single_piece(data[:end].encode("latin-1"))[-1] or len(library._encode_single_piece(data[:end].encode("latin-1"))) == 1


def test_edits_are_exact_and_local(vocabulary, library):
    draw = random.Random(4)
    text = bpe.EditableText(vocabulary)
    for _ in range(600):
        start = draw.randint(0, len(text.text))
        end = min(len(text.text), start + draw.randint(0, 4))
        if draw.random() < 0.3:
            start = end = len(text.text)
        wanted = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 5)))
        text.replace(start, end, wanted)
        assert text.ids() == library.encode_ordinary(text.text)
    long = bpe.EditableText(vocabulary, "some words follow each other here " * 200)
    assert long.replace(3000, 3003, "xyz") < 12 and long.append("more") < 4
    assert long.ids() == library.encode_ordinary(long.text)


def test_digests(frame, odd, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus.bpe_digests(frame(odd), *corpus.tokenizer()).collect()}
    for i, text in enumerate(odd):
        ids = library.encode_ordinary(text or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(text or ""))
    assert corpus.bpe_digests(frame([]), *corpus.tokenizer()).collect() == []


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_query_against_sql(spark, connection, name):
    assert compare(spark, connection, SMALL, corpus.QUERIES[name], corpus.ORACLES[name]) is None


def test_all_are_registered():
    names = contract.queries()
    assert [n for n in names if n.startswith("op")] == list(corpus.QUERIES) and "pipeline" in names
    assert [n.split("_")[0] for n in corpus.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_shortage_goes_to_siblings_first(spark):
    """Leaf a/x/1 is short: a/x/2 gets its rest; all of a/x is short then: a/y; b is as planned."""
    levels = tuple(mixing.Level(n, n, {}) for n in ("one", "two", "three"))
    mixture = mixing.Mixture(levels, share=(1, 2), epochs=1)
    rows = [("a", "x", "1", 10), ("a", "x", "2", 60), ("a", "y", "1", 400), ("b", "x", "1", 330)]
    leaves = spark.createDataFrame(rows, "one string, two string, three string, tokens long")
    got = {tuple(r)[:3]: r["budget"] for r in mixing.budgets(leaves, mixture).collect()}
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 60, ("a", "y", "1"): 130, ("b", "x", "1"): 200}
    short = leaves.where("one = 'b' OR two = 'x'").withColumn("tokens", leaves["tokens"])
    got = {tuple(r)[:3]: r["budget"] for r in mixing.budgets(short, mixture).collect()}
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 60, ("b", "x", "1"): 130}


def test_mixing_odd_rows(spark, frame, odd):
    used = mixing.mix(frame(odd)).toPandas()
    assert used.groupby("doc_id")["epoch"].apply(lambda e: sorted(e) == list(range(len(e)))).all()
    words = {i: len((t or "").split()) for i, t in enumerate(odd)}
    assert used["n_tokens"].sum() <= sum(words.values()) and used["n_tokens"].sum() > 0.5 * sum(words.values())
    assert mixing.mix(frame([])).collect() == [] and mixing.mix(frame([None, ""])).collect() == []
    twice = frame(odd).unionByName(frame(odd))
    counts = mixing.mix(twice).groupBy("doc_id", "n_tokens").count().toPandas()
    assert (counts["count"] % 2 == 0).all()


def test_one_row_of_a_group_stays(spark, frame):
    """Repeated and missing ids are told apart by their texts; of equal rows one stays; empty texts all do."""
    a, b, c = (" ".join(f"{x}{n}" for n in range(30)) for x in "abc")
    near = a.replace("a29", "z")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (2, near), (7, b), (7, None), (7, None), (None, " ")]
    kept = stages.keep_first_copies(spark, frame([t for _, t in rows], [i for i, _ in rows]), SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, a), (2, b), (None, c), (7, None), (7, None), (None, " ")], key=repr)


def test_rows_without_id_are_mixed_by_their_texts(spark, frame):
    texts = [" ".join(f"{n}w{i}" for i in range(20)) for n in range(60)]
    levels = (mixing.Level("lang", "'x'", {}),)
    used = mixing.mix(frame(texts, [None] * 60), mixing.Mixture(levels, share=(1, 2), epochs=1)).toPandas()
    assert len(used) == 30 and used["doc_id"].isna().all()


def test_pipeline(spark):
    """Each stage against its own operator or a plain computation on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    good = stages.stage(stages.keep_good(spark, docs, SMALL), "good")
    kept = corpus.op9_quality_rules(spark, SMALL).where("kept")
    assert ids(good) == ids(kept) and tuple(good.columns) == stages.COLUMNS
    cleaned = stages.stage(stages.drop_lines(spark, good, SMALL), "cleaned")
    assert {(r["doc_id"], sha(r["text"])) for r in cleaned.collect()} == {(r["doc_id"], r["kept_sha256"]) for r in lines.line_digests(good).collect()}
    assert tuple(cleaned.columns) == stages.COLUMNS
    first = stages.stage(stages.keep_first_copies(spark, cleaned, SMALL), "first")
    found = near_duplicates.near_duplicates(cleaned).toPandas()
    assert ids(first) == sorted(found[found["kept"]]["doc_id"]) and len(first.collect()) == found["component_id"].nunique()
    mixed = stages.stage(stages.mix(spark, first, SMALL), "mixed")
    assert ids(mixed) == ids(mixing.mix(first)) and tuple(mixed.columns) == stages.COLUMNS
    encoded = {r["doc_id"]: r["decoded_sha256"] for r in stages.encode(spark, mixed, SMALL).collect()}
    assert encoded == {r["doc_id"]: sha(r["text"]) for r in mixed.collect()}
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], encoded[r["doc_id"]]) for r in mixed.collect())


def test_stages_accept_odd_rows(spark, frame, odd):
    docs = frame(odd)
    for _, apply in corpus_pipeline.STAGES:
        docs = stages.stage(apply(spark, docs, SMALL), "odd")
    assert docs.count() > 0
    empty = frame([])
    for _, apply in corpus_pipeline.STAGES:
        empty = stages.stage(apply(spark, empty, SMALL), "empty")
    assert empty.count() == 0
