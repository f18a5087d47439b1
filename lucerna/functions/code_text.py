"""Lexical views of shader source used by several operators."""

from __future__ import annotations

import re

#: A string literal (group 1), a line comment (group 2, a backslash carries it to the next line) or a block
#: comment (group 3, an open one reaches the end of the text).
LEXEMES = re.compile(
    r'"([^"\\\r\n]*(?:\\(?:\r\n|[\s\S])[^"\\\r\n]*)*)"'
    r"|//([^\\\r\n]*(?:\\(?:\r\n|[\s\S]|\Z)[^\\\r\n]*)*)"
    r"|/\*([\s\S]*?)(?:\*/|\Z)"
)


def without_comments(code: str) -> str:
    """Replace every comment by one blank; string literals stay."""
    if "/" not in code:
        return code
    return LEXEMES.sub(lambda m: m.group(0) if m.group(1) is not None else " ", code)


def spans(code: str):
    """Yield (kind, text) for string literals ('string') and comments ('line', 'block'), in order."""
    for m in LEXEMES.finditer(code):
        if m.group(1) is not None:
            yield "string", m.group(1)
        elif m.group(2) is not None:
            yield "line", m.group(2)
        else:
            yield "block", m.group(3) or ""
