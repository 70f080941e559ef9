"""Templates: text with {expressions}; a backslash escapes braces and itself."""

from __future__ import annotations

import re

from quadloom.errors import MappingError

PIECE = re.compile(r"\\(?P<escaped>[{}\\])|(?P<bad>\\)|\{(?P<expr>(?:[^{}\\]|\\[{}\\])*)\}|(?P<open>\{)|(?P<text>[^{\\]+)")


def parse_template(template: str) -> list[tuple[str, str]]:
    """("text" or "expr", value), adjoining texts joined."""
    out: list[tuple[str, str]] = []
    for m in PIECE.finditer(template):
        if m.group("bad"):
            raise MappingError(f"a backslash escapes only braces and backslashes: {template!r}")
        if m.group("open"):
            raise MappingError(f"a brace is not closed, or opened within braces: {template!r}")
        if m.group("expr") is not None:
            out.append(("expr", re.sub(r"\\([{}\\])", r"\1", m.group("expr"))))
            continue
        text = m.group("escaped") or m.group("text")
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + text)
        else:
            out.append(("text", text))
    return out
