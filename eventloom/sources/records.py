"""Small readers for text that regular expressions cannot take apart: markup, escapes.

Each works on one page or one literal at a time inside a task's Arrow batches.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")


def template_parameters(markup: str | None, template: str) -> list[tuple[str, str | None]] | None:
    """Names and values of the first use of a template; None if the page has none.

    Bars and braces inside links and inner templates belong to the value.
    """
    found = re.search(r"\{\{" + re.escape(template) + r"\s*(\||\}\})", markup or "")
    if found is None:
        return None
    if found.group(1) == "}}":
        return []
    parts, begin, depth = [], found.end(), 0
    for token in _TOKEN.finditer(markup, found.end()):
        kind = token.group()
        if kind in ("{{", "[["):
            depth += 1
        elif depth and kind in ("}}", "]]"):
            depth -= 1
        elif not depth and kind in ("|", "}}"):
            parts.append(markup[begin : token.start()])
            begin = token.end()
            if kind == "}}":
                break
    else:
        parts.append(markup[begin:])
    out = []
    for part in parts:
        name, equals, value = part.partition("=")
        out.append((name.strip(), value.strip() if equals else None))
    return out


_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    """Escapes of triple literals and IRIs."""
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)
