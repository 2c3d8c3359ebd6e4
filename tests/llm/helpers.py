"""Rows and texts that the tests of the corpus operators share."""

import hashlib
import random
import re

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use for columns of their own
        T.StructField("h", T.StringType()),
        T.StructField("lo", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("copy", T.StringType()),
    ]
)


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def rows_of(texts, ids=None):
    """Rows with every other column filled, null or clashing."""
    ids = range(len(texts)) if ids is None else ids
    langs, sources = ["en", "de", None], ["src0", "src9", "src19", None]
    return [(i, t, langs[n % 3], sources[n % 4], len(t or ""), "h", None, "kept", "c") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]


def odd_texts(seed: int = 1) -> list:
    """Copies, near copies, shared passages, nulls, empty, white, one-word, very long, periodic."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghiéß漢") for _ in range(draw.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passages = [text(60) for _ in range(3)]
    base = text(120)
    out = [None, "", " \t\n\x0b ", "one", "Two Words", base, base, base.upper(), "x" * 700, "ab" * 400, "same " * 300]
    for n in range(12):
        words = base.split()
        for _ in range(n):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        out.append(" ".join(words))
    for n in range(24):
        out.append(text(draw.randint(0, 60)) + ("\n" if n % 2 else " ") + passages[n % 3] + " " + text(draw.randint(0, 60)))
    line = "A Line That Many Documents Share, Of More Than Forty Letters"
    for n in range(7):
        out.append(f"{text(30)}\n  {line if n % 2 else line.lower()}\t\r\n{text(20)}\n{line}")
    out.append(text(6000) + " " + passages[0])
    out += [text(40) for _ in range(10)]
    return out
