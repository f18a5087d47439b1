"""Text expressions that stay in the JVM; every one takes a column and treats null as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word's start and end as regular-expression parts that Java and RE2 read alike.
START, STOP = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
GAP = r"[ \t\r\n\f]"



def fast(pattern: str, letters: str) -> str:
    """``pattern`` for Java with its first START told what letters may follow: most positions fail at once."""
    return pattern.replace(START, rf"(?=[{letters}])(?<![\p{{L}}\p{{N}}_])", 1)


#: GLSL keywords that are no search terms.
STOPWORDS = (
    "void float int bool vec2 vec3 vec4 mat2 mat3 mat4 ivec2 ivec3 ivec4 if else for while do return break continue in out inout "
    "const uniform varying attribute true false discard struct precision highp mediump lowp sampler2d samplercube"
).split()


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def search_terms(c) -> Column:
    """Identifiers as search terms: the whole word without underscores, then its parts by underscore and case.

    Words shorter than two letters and GLSL keywords are left out. A word of one part comes twice, so plain
    words weigh double against composed ones. Text without ASCII letters has none.
    """
    found = F.regexp_extract_all(text(c), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    parts = lambda w: F.concat(
        F.array(F.lower(F.replace(w, F.lit("_"), F.lit("")))),
        F.split(F.lower(F.regexp_replace(F.regexp_replace(F.replace(w, F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")), " +"))
    split = F.flatten(F.transform(found, lambda w: F.when(w.rlike("_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"), parts(w)).otherwise(F.array_repeat(F.lower(w), 2))))
    return F.filter(split, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))


def line_count(c) -> Column:
    """Lines as split at line ends, 0 for ''; a final line end begins no line."""
    t = F.regexp_replace(text(c), r"\r\n|\r", "\n")
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.regexp_replace(t, "\n", "")) + F.when(t.endswith("\n"), 0).otherwise(1)).cast("int")


def head_lines(c, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.regexp_replace(text(c), r"\r\n|\r", "\n"), "\n"), 1, n), "\n")


def without_comments(c) -> Column:
    """Block comments, then line comments, removed; string literals are not regarded."""
    return F.regexp_replace(F.regexp_replace(text(c), r"/\*[\s\S]*?\*/", ""), r"//[^\n]*", "")


def count_of(c: Column, letter: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def clip(c, limit: int, end: str = "\n// ...") -> Column:
    t = text(c)
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s+$", ""), F.lit(end))).otherwise(t)


def brief(c, limit: int = 80) -> Column:
    """One line, cut with an ellipsis."""
    t = F.regexp_replace(text(c), "\n", " ")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def slug(path) -> Column:
    """local_ id of a relative path: runs of other characters become one underscore, the suffix is dropped."""
    stem = F.regexp_replace(text(path), r"(?<=[^/])\.[^./]*$", "")
    parts = F.transform(F.split(stem, "/"), lambda p: F.lower(F.regexp_replace(F.regexp_replace(p, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "_")
    return F.concat(F.lit("local_"), F.when(joined == "", "unnamed").otherwise(joined))


def code_hash(image, common) -> Column:
    return F.sha2(F.concat(text(image), F.lit("\n---\n"), text(common)), 256)
