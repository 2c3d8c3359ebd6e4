"""Reads Turtle statements: directives, nested blank nodes, collections and literals."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa

from eventloom.sources.records import unescape

#: Fixed values of the RDF vocabulary.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>\n]*>)|(?P<long>\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+''')"""
    r"""|(?P<text>"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<mark>[;,\[\]()])"""
    r"""|(?P<name>(?:\.(?=\d)|\\.|[^\s;,.<>"'\[\]()\#\\^@])(?:[^\s;,.<>"'\[\]()\#\\]++|\\.|\.++(?=[^\s;,.<>"'\[\]()\#]))*+)|(?P<end>\.)""",
    re.DOTALL | re.VERBOSE,
)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_LOCAL_ESCAPE = re.compile(r"\\(.)")
_VALUE = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|true|false")


class Names:
    """Prefixes and base of a place in a file."""

    def __init__(self, prefixes: dict[str, str] | None = None, base: str | None = None):
        self.prefixes, self.base = prefixes or {}, base

    def iri(self, written: str) -> str:
        """An absolute IRI; without a base, a relative one stays as it is."""
        if self.base is None or _SCHEME.match(written):
            return written
        path, mark, fragment = written.partition("#")
        return (urljoin(self.base, path) if path else self.base.partition("#")[0]) + mark + fragment

    def named(self, text: str) -> str:
        prefix, _, local = text.partition(":")
        if prefix == "_":
            return text
        if prefix not in self.prefixes:
            raise ValueError(f"the prefix {prefix}: is not declared")
        return self.prefixes[prefix] + _LOCAL_ESCAPE.sub(r"\1", local)

    def declared(self, name: str | None, iri: str) -> Names:
        """With one more prefix, or another base for no name."""
        iri = self.iri(iri)
        return Names(self.prefixes, iri) if name is None else Names({**self.prefixes, name: iri}, self.base)


def _scan(statement: str) -> Iterator[tuple[str, str]]:
    at = 0
    for token in _TOKEN.finditer(statement):
        if token.start() != at:
            break
        if token.lastgroup:
            yield token.lastgroup, token.group()
        at = token.end()
    if at < len(statement):
        raise ValueError(f"not Turtle: {statement[at : at + 100]!r}")


def _tokens(statement: str) -> list[tuple[str, str]]:
    return list(_scan(statement))


def _head(statement: str) -> list[tuple[str, str]]:
    """The tokens of the directives that a statement begins with; the others are not looked at."""
    out: list[tuple[str, str]] = []
    rest = 0  # of a directive
    for kind, text in _scan(statement):
        if rest:
            rest -= 1
        elif kind != "end":
            word = text.lower().lstrip("@")
            if kind not in ("name", "lang") or word not in ("prefix", "base"):
                break
            rest = 2 if word == "prefix" else 1
        out.append((kind, text))
    return out


def _directives(tokens: list[tuple[str, str]]) -> tuple[list[tuple[str | None, str]], int]:
    """Prefixes and bases that a statement begins with, and the number of tokens they take."""
    found: list[tuple[str | None, str]] = []
    at = 0
    while at < len(tokens):
        word = tokens[at][1].lower().lstrip("@")
        if tokens[at][0] not in ("name", "lang") or word not in ("prefix", "base"):
            break
        taken = tokens[at + 1 : at + (3 if word == "prefix" else 2)]
        if not taken or taken[-1][0] != "iri" or (word == "prefix" and (len(taken) < 2 or not taken[0][1].endswith(":"))):
            raise ValueError(f"not a directive: {tokens[at : at + 4]}")
        found.append((taken[0][1][:-1] if word == "prefix" else None, unescape(taken[-1][1][1:-1])))
        at += 1 + len(taken)
        if at < len(tokens) and tokens[at][0] == "end":
            at += 1
    return found, at


def _text(kind: str, token: str) -> str:
    return unescape(token[3:-3] if kind == "long" else token[1:-1])


class _Frame:
    """What is open: a statement, the inside of a blank node, or a collection."""

    def __init__(self, kind: str, subject: str | None = None):
        self.kind, self.subject, self.predicate, self.first = kind, subject, None, None
        self.objects, self.done = 0, False  # of the predicate; of any


def read_statement(statement: str, names: Names, label: str) -> list[tuple[str, str, str, str | None]]:
    """(s, p, o, lang) of one statement; ``label`` makes its own blank nodes unique."""
    tokens = _tokens(statement)
    directives, at = _directives(tokens)
    for name, iri in directives:
        names = names.declared(name, iri)
    out: list[tuple[str, str, str, str | None]] = []
    stack = [_Frame("statement")]
    blanks = 0

    def blank() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:{label}-{blanks}"

    def wrong() -> ValueError:
        return ValueError(f"not a Turtle statement: {statement[:200]!r}")

    def term(value: str, lang: str | None = None, literal: bool = False) -> None:
        frame = stack[-1]
        if frame.kind == "list":
            node = blank()
            if frame.subject is None:
                frame.first = node
            else:
                out.append((frame.subject, RDF + "rest", node, None))
            frame.subject = node
            out.append((node, RDF + "first", value, lang))
        elif literal and frame.predicate is None:
            raise wrong()
        elif frame.subject is None:
            frame.subject = value
        elif frame.predicate is None:
            frame.predicate = value
        else:
            out.append((frame.subject, frame.predicate, value, lang))
            frame.objects, frame.done = frame.objects + 1, True

    while at < len(tokens):
        kind, text = tokens[at]
        at += 1
        frame = stack[-1]
        if kind == "iri":
            term(names.iri(unescape(text[1:-1])))
        elif kind in ("text", "long"):
            lang = None
            if at < len(tokens) and tokens[at][0] == "lang":
                lang = tokens[at][1][1:]
                at += 1
            elif at < len(tokens) and tokens[at][0] == "type":
                at += 2  # with the type itself
            term(_text(kind, text), lang, literal=True)
        elif kind == "name":
            if ":" in text:
                term(names.named(text))
            elif text == "a" and frame.kind != "list" and frame.subject is not None and frame.predicate is None:
                term(RDF + "type")
            elif _VALUE.fullmatch(text):
                term(text, literal=True)
            else:
                raise wrong()
        elif text == "[":
            stack.append(_Frame("blank", blank()))
        elif text == "(":
            stack.append(_Frame("list"))
        elif text == "]" and frame.kind == "blank":
            if frame.predicate is not None and not frame.objects:
                raise wrong()
            stack.pop()
            # what has its own properties may stand alone
            if len(stack) == 1 and stack[0].subject is None:
                stack[0].done = bool(frame.done)
            term(frame.subject)
        elif text == ")" and frame.kind == "list":
            stack.pop()
            if frame.first:
                out.append((frame.subject, RDF + "rest", RDF + "nil", None))
            term(frame.first or RDF + "nil")
        elif text == ";" and frame.kind != "list":
            if frame.predicate is not None and not frame.objects:
                raise wrong()
            frame.predicate, frame.objects = None, 0
        elif text == "," and frame.kind != "list" and frame.objects:
            pass
        elif kind == "end" and len(stack) == 1 and at == len(tokens):
            if not frame.done or (frame.predicate is not None and not frame.objects):
                raise wrong()
            return out
        else:
            raise wrong()
    if len(stack) > 1 or stack[0].subject is not None:
        raise wrong()
    return out


def find_directives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file``, ``start``, ``seq``, ``n``, ``name`` and ``iri`` of all directives; no name is a base."""
    for batch in batches:
        rows = []
        for file, start, seq, text in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "seq", "text")), strict=True):
            rows += [(file, start, seq, n, *d) for n, d in enumerate(_directives(_head(text))[0])]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "seq", "n", "name", "iri"])


class _Declared:
    """The names known at any place of a file, from its directives as a JSON list."""

    def __init__(self, written: str | None):
        rows = json.loads(written) if written else []
        self.places = [(r["start"], r["seq"]) for r in rows]
        self.names = [Names()]
        for row in rows:
            self.names.append(self.names[-1].declared(row.get("name"), row["iri"]))

    def before(self, start: int, seq: int) -> Names:
        return self.names[bisect_left(self.places, (start, seq))]


def read_statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements with their file's directives to triples."""
    known: dict[str | None, _Declared] = {}
    for batch in batches:
        rows: list[tuple] = []
        for file, start, seq, text, written in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "seq", "text", "directives")), strict=True):
            if written not in known:
                known.clear()  # files come one after the other
                known[written] = _Declared(written)
            label = f"b{file & (1 << 64) - 1:x}-{start}-{seq}"
            rows += read_statement(text, known[written].before(start, seq), label)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["s", "p", "o", "lang"])
