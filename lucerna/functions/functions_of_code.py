"""Brace matching, which regular expressions cannot do: functions and sections of shader code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRACE = re.compile("[{}]")
#: How a function definition begins, and words that are no function's type or name.
HEAD = re.compile(r"([A-Za-z_]\w*)\s+([A-Za-z_]\w*)\s*\(([^;{]*)\)\s*\{", re.A)
CONTROL = frozenset("if for while switch return else".split())
FUNCTION = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "signature", "body")])


def body_end(code: str, at: int) -> int:
    """Index after the brace that closes the one at ``at``; the text's end if none does."""
    depth = 0
    for m in BRACE.finditer(code, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def functions(code: str | None) -> list[dict]:
    """Every function definition in order, those inside of others included."""
    out = []
    for m in HEAD.finditer(code or ""):
        kind, name, params = m.groups()
        if kind not in CONTROL and name not in CONTROL:
            out.append({"name": name, "signature": f"{kind} {name}({params.strip()})", "body": code[m.start() : body_end(code, m.end() - 1)]})
    return out


def sections(code: str | None) -> dict[str, str]:
    """Title to code: 'globals' outside of functions, and each closed function; a later one of a name wins."""
    out: dict[str, str] = {}
    outside, at = [], 0
    for m in HEAD.finditer(code or ""):
        if m.start() < at or m.group(1) in CONTROL or m.group(2) in CONTROL:
            continue
        end = body_end(code, m.end() - 1)
        if code[end - 1] != "}":
            continue
        outside.append(code[at : m.start()])
        out[m.group(2)] = code[m.start() : end]
        at = end
    rest = "".join([*outside, (code or "")[at:]]).strip()
    return ({"globals": rest} if rest else {}) | out


@F.pandas_udf(T.ArrayType(FUNCTION))
def extract_functions(code: pd.Series) -> pd.Series:
    return code.map(functions)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def split_sections(code: pd.Series) -> pd.Series:
    return code.map(sections)
