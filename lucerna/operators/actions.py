"""What the agents compute without a model: parsing, techniques, constraints, critique, contexts, call statistics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.functions.functions_of_code import body_end
from lucerna.functions.text import GAP, START, clip, fast, line_count, text
from lucerna.operators import analysis

#: Variables the host gives to every shader.
BUILTINS = ("iResolution", "iTime", "iTimeDelta", "iFrame", "iChannelTime", "iMouse", "iDate", "iSampleRate", "iChannelResolution", "iChannel0", "iChannel1", "iChannel2", "iChannel3")
NUMBER = r"[0-9]*\.?[0-9]+"
VEC3 = rf"vec3{GAP}*\({GAP}*({NUMBER}{GAP}*,{GAP}*{NUMBER}{GAP}*,{GAP}*{NUMBER}){GAP}*\)"


def _names(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda n: n.isNotNull())


#: How a function definition begins, and words that are no type of one.
DEFINED = rf"{START}([a-zA-Z_][a-zA-Z0-9_]*){GAP}+([a-zA-Z_][a-zA-Z0-9_]*){GAP}*\([^;{{]*\){GAP}*\{{"
NO_TYPES = ("if", "for", "while", "switch", "return", "else")


def defined(code, no_types=NO_TYPES[:5]) -> Column:
    """Names of the functions that a code defines, in order."""
    c = text(code)
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(fast(DEFINED, "a-zA-Z_")), F.lit(1)).alias("k"), F.regexp_extract_all(c, F.lit(fast(DEFINED, "a-zA-Z_")), F.lit(2)).alias("n"))
    return F.transform(F.filter(pairs, lambda p: ~p["k"].isin(*no_types)), lambda p: p["n"])


def key_functions(code, most: int = 8) -> Column:
    """The first different functions that a code defines, without its entry."""
    return F.slice(F.array_distinct(F.filter(defined(code, NO_TYPES), lambda n: (n != "mainImage") & ~n.isin(*NO_TYPES))), 1, most)


def analyzed(records: DataFrame) -> DataFrame:
    """The records with what their code tells: key functions, visual features, summary, whether it compiles (where that
    is not known: whether it has an entry), and the quality by all these."""
    rows = records.withColumn("key_functions", key_functions("code_image")).withColumn("compile_ok", F.coalesce("compile_ok", F.lit(False)) | analysis.has_entry(text("code_image")))
    return rows.withColumn("visual_features", analysis.visual_features()).withColumn("algorithm_summary", analysis.summary_text()).withColumn("quality_score", analysis.quality())


def parsed(code) -> dict[str, Column]:
    """has_main, functions defined, builtins used, uniforms declared and lines of a code."""
    c = text(code)
    return {
        "functions": defined(code),
        "has_main": c.contains("mainImage"), "builtins": F.filter(F.array(*map(F.lit, BUILTINS)), lambda b: c.contains(b)),
        "uniforms": F.regexp_extract_all(c, F.lit(rf"uniform{GAP}+[a-zA-Z_][a-zA-Z0-9_]*{GAP}+([a-zA-Z_][a-zA-Z0-9_]*){GAP}*;"), F.lit(1)), "lines": line_count(code)}


def fallback_techniques(code, functions: str) -> Column:
    """Techniques guessed from function names and code; '2d-pattern' where nothing is found.

    As in the replaced system any 'ro' or 'rd' within the function names counts as ray marching.
    """
    own = _names(functions)
    names, low = F.lower(F.array_join(own, " ")), F.lower(text(code))
    found = F.array_compact(F.array(
        F.when(low.contains("raymarch") | names.contains("ro") | names.contains("rd"), F.lit("raymarching")), F.when(F.exists(own, lambda f: f.startswith("sd")), F.lit("sdf")),
        F.when(names.contains("noise") | names.contains("hash"), F.lit("noise")), F.when(low.contains("mandelbrot") | low.contains("fractal"), F.lit("fractal"))))
    return F.when(F.size(found) == 0, F.array(F.lit("2d-pattern"))).otherwise(found)


def constraints(wish) -> Column:
    """Hard wishes: things to avoid, a greatest number of lines, no textures."""
    t = text(wish)
    avoid = F.transform(F.regexp_extract_all(t, F.lit(r"不要用([\x{4e00}-\x{9fa5}A-Za-z0-9 ]{2,30})"), F.lit(1)), lambda x: F.concat(F.lit("avoid "), F.trim(x)))
    lines = F.transform(F.regexp_extract_all(t, F.lit(r"<=?[ \t]*([0-9]+)[ \t]*行"), F.lit(1)), lambda x: F.concat(F.lit("<= "), x, F.lit(" lines")))
    bare = F.lower(t).contains("no texture") | t.contains("无纹理") | t.contains("不要用纹理")
    return F.concat(avoid, lines, F.when(bare, F.array(F.lit("no external textures"))).otherwise(F.array().cast("array<string>")))


#: What a code of an effect has one of; other effects are never seen.
SHOWS = {"raymarching": ("raymarch", "ro", "rd", "march"), "sdf": ("sd", "distance"), "noise": ("noise", "hash", "fract(sin"), "fractal": ("mandelbrot", "julia", "iter")}


def critique(compiles: Column, code, effect: Column, dynamic: Column) -> Column:
    """Share of kept promises: it compiles; it has iTime, if it should move; it shows the effect, if one is wanted."""
    c = F.lower(text(code))
    shown = F.lit(False)
    for name, words in SHOWS.items():
        shown = shown | ((effect == name) & F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w)))
    kept = compiles.cast("int") + (dynamic & c.contains("itime")).cast("int") + shown.cast("int")
    return kept / (1 + dynamic.cast("int") + (effect != "").cast("int"))


def fenceless(reply) -> Column:
    """A reply stripped, and without the code fence around it."""
    t = F.regexp_replace(text(reply), r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def json_of(reply) -> Column:
    """The JSON object in a reply: the whole of it, else from the first to the last brace, else the reply."""
    t = fenceless(reply)
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    return F.when(t.startswith("{") & t.endswith("}"), t).when((first > 0) & t.contains("}") & (first < last), F.substring(t, first, last - first + 1)).otherwise(t)


EXPLAINED = r"^[ \t]*//[ \t]*EXPLAIN:([^\n]*)((?:\n[ \t]*//[^\n]*)*)"


def explanation(reply) -> Column:
    """The comment lines that a reply begins with after EXPLAIN:, without marks and blank lines; '' if there are none."""
    t = fenceless(reply)
    lines = F.split(F.concat(F.regexp_replace(F.regexp_extract(t, EXPLAINED, 1), r"^[ \t]+", ""), F.regexp_replace(F.regexp_extract(t, EXPLAINED, 2), r"\n[ \t]*//[ \t]?", "\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"[ \t\r]+$", "")), lambda x: x != ""), "\n")


def code_of(reply) -> Column:
    """A reply without fence and explanation."""
    return F.regexp_replace(F.regexp_replace(fenceless(reply), EXPLAINED, ""), r"^\s+|\s+$", "")


def prompt_blocks(blocks, budget: int = 3600, least: int = 900) -> Column:
    """The leading reference texts of a prompt: the second up to 1600 characters, the others up to 1000, each cut to
    what is left of ``budget`` but not below ``least``; none after the budget is used. Blank texts are left out."""
    rows = F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda b, i: clip(b, 1000) if i is None else F.when(i == 1, clip(b, 1600)).otherwise(clip(b, 1000)))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def add(so_far, block):
        room = F.greatest(F.lit(least), budget - so_far["used"])
        cut = F.regexp_replace(F.substring(block, F.lit(1), room), r"\s+$", "")
        own = F.when((so_far["used"] + F.length(block) > budget) & (F.length(block) > room), F.concat(cut, F.lit("\n// ..."))).otherwise(block)
        blank = F.regexp_replace(own, r"\s+", "") == ""
        more = F.struct((so_far["used"] + F.length(own)).alias("used"), F.concat(so_far["kept"], F.array(own)).alias("kept"))
        return F.when((so_far["used"] >= budget) | blank, so_far).otherwise(more)

    return F.aggregate(rows, start, add, lambda x: x["kept"])


def section_prompt(sections, whole: int = 16000, each: int = 4000) -> Column:
    """The sections of a code (map of title to text) under their titles. All of it up to ``whole`` characters; beyond,
    sections are cut to ``each`` until ``whole`` is used, and the others are named only."""
    rows = F.map_entries(sections)
    total = F.aggregate(rows, F.lit(0), lambda n, r: n + F.length(r["value"]))
    head = lambda r: F.concat(F.lit("\n--- section: "), r["key"], F.lit(" ---\n"))
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("out"))

    def add(so_far, r):
        cut = F.when(F.length(r["value"]) > each, F.concat(F.substring(r["value"], 1, each), F.lit("\n/* cut */"))).otherwise(r["value"])
        named = F.struct(so_far["used"].alias("used"), F.concat(so_far["out"], head(r), F.lit("/* left out */\n")).alias("out"))
        return F.when(so_far["used"] >= whole, named).otherwise(F.struct((so_far["used"] + F.length(cut)).alias("used"), F.concat(so_far["out"], head(r), cut, F.lit("\n")).alias("out")))

    plain = F.array_join(F.transform(rows, lambda r: F.concat(head(r), r["value"], F.lit("\n"))), "")
    return F.when(total <= whole, plain).otherwise(F.aggregate(rows, start, add, lambda x: x["out"]))


def remapped(log, lines: Column, before: int) -> Column:
    """A compiler's log with the lines of the wrapped file told as lines of the code: ``before`` lines stand before it,
    and it has ``lines``. Both notations of drivers, 0(12) and 0:12:, are read."""
    def told(n):
        n = n.cast("long")
        return F.when(n <= before, F.concat(n.cast("string"), F.lit("(prologue)"))).when(n - before <= lines, F.concat(n.cast("string"), F.lit("(user:"), (n - before).cast("string"), F.lit(")"))).otherwise(F.concat(n.cast("string"), F.lit("(epilogue)")))

    out = text(log)
    for mark, left, right in ((r"\b0\(([0-9]{1,9})\)", "0(", ")"), (r"\b0:([0-9]{1,9}):", "0:", ":")):
        between, numbers = F.split(out, mark), F.regexp_extract_all(out, F.lit(mark), F.lit(1))
        own = F.transform(numbers, lambda n, i: F.concat(F.lit(left), told(n), F.lit(right), F.get(between, i + 1)))
        out = F.concat(F.get(between, F.lit(0)), F.array_join(own, ""))
    return out


def base_colour(code) -> Column:
    """The last vec3 literal with all parts in 0..1 and one above 0, as three numbers; grey if there is none."""
    parts = F.transform(F.regexp_extract_all(text(code), F.lit(VEC3), F.lit(1)), lambda v: F.transform(F.split(v, ","), lambda x: F.trim(F.regexp_replace(x, r"[\r\n\f]", "")).cast("double")))
    fit = F.filter(parts, lambda p: F.forall(p, lambda x: x <= 1.0) & F.exists(p, lambda x: x > 0.0))
    return F.when(F.size(fit) > 0, F.element_at(fit, -1)).otherwise(F.array(*[F.lit(0.5)] * 3))


def _clip(t: str, limit: int) -> str:
    return t if len(t) <= limit else t[:limit].rstrip() + "\n// ..."


def _snippet(code: str, name: str, limit: int) -> str:
    """The first definition of a function up to the brace that closes it, or to the end if none does."""
    if not name or not (m := re.search(r"\b[A-Za-z_][A-Za-z0-9_]*\s+" + re.escape(name) + r"\s*\([^;{}]*\)\s*\{", code)):
        return ""
    return _clip(code[m.start() : body_end(code, m.end() - 1)], limit)


def context_sections(code: str | None, names, matched=None) -> str:
    """Matched chunks (functions first, then by score), mainImage and the first three key functions of a code."""
    code, parts, titles = code or "", [], set()
    ranked = sorted([] if matched is None else matched, key=lambda x: (x["kind"] != "function", -(x["score"] or 0.0)))
    for chunk in ranked[:4]:
        kind = chunk["kind"] or "chunk"
        title = chunk["title"] or kind
        if (own := (chunk["text"] or "").strip()) and (kind, title) not in titles:
            titles.add((kind, title))
            parts.append(f"[matched_{kind}: {title}]\n" + _clip(own, 1500))
    if ("function", "mainImage") not in titles and "function mainImage" not in "\n".join(parts) and (own := _snippet(code, "mainImage", 1400)):
        parts.append("[context: mainImage]\n" + own)
    for name in ([] if names is None else list(names))[:3]:
        if ("function", name) not in titles and (own := _snippet(code, name, 1200)):
            parts.append(f"[context: key_function {name}]\n" + own)
    return "\n\n".join(parts)


@F.pandas_udf(T.StringType())
def _sections(code: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([context_sections(c, n) for c, n in zip(code, names)], dtype=object)


@F.pandas_udf(T.StringType())
def _hit_sections(code: pd.Series, names: pd.Series, matched: pd.Series) -> pd.Series:
    return pd.Series([context_sections(c, n, m) for c, n, m in zip(code, names, matched)], dtype=object)


def reference_context(tags: str, features: str, quality: str, summary: str, code: str, most: int = 3600, names: str | None = None, matched: str | None = None) -> Column:
    """Reference text of a hit: topics and quality, summary, matched chunks, mainImage and key functions, cut to ``most``.

    ``names``: column of key functions; ``matched``: array of (kind, title, text, score). Without any section it is the code.
    """
    tag = F.array_join(F.slice(_names(tags), 1, 8), ", ")
    look = F.array_join(F.slice(_names(features), 1, 6), ", ")
    score = F.coalesce(F.when(~F.isnan(quality), F.col(quality)), F.lit(0.0))
    meta = F.concat_ws(" | ", F.when(tag != "", F.concat(F.lit("tags="), tag)), F.when(look != "", F.concat(F.lit("visual="), look)), F.when(score != 0, F.concat(F.lit("quality="), F.format_string("%.2f", score))))
    keys = _names(names) if names else F.array().cast("array<string>")
    own = _hit_sections(text(code), keys, F.col(matched)) if matched else _sections(text(code), keys)
    parts = F.concat_ws("\n\n", F.when(meta != "", F.concat(F.lit("[meta] "), meta)), F.when(text(summary) != "", F.concat(F.lit("[algorithm_summary]\n"), clip(summary, 700))), F.nullif(own, F.lit("")))
    return clip(F.when(parts != "", parts).otherwise(text(code)), most)


def masked(secret, keep: int = 4) -> Column:
    """A secret as shown in logs: its first letters and its length."""
    t = text(secret)
    return F.when(t == "", "<unset>").when(F.length(t) <= keep, F.repeat(F.lit("*"), F.length(t))).otherwise(F.concat(F.substring(t, 1, keep), F.lit("******(len="), F.length(t).cast("string"), F.lit(")")))


def call_stats(calls: DataFrame, request: str, reply: str, by: str) -> DataFrame:
    """(by, calls, cached, chars_in, chars_out): a request seen before, first come by hash, counts as cached."""
    rows = calls.select(text(by).alias(by), F.sha1(text(request)).alias("key"), F.length(text(request)).alias("i"), F.length(text(reply)).alias("o"))
    once = rows.groupBy(by, "key").agg(F.count("*").alias("n"), F.sum("i").alias("i"), F.sum("o").alias("o"))
    return once.groupBy(by).agg(F.sum("n").alias("calls"), (F.sum("n") - F.count("*")).alias("cached"), F.sum("i").alias("chars_in"), F.sum("o").alias("chars_out"))


def readiness(components: DataFrame, name: str, ok: str) -> DataFrame:
    """(name, ready): a component is ready if all its parts are; null counts as not ready."""
    return components.groupBy(text(name).alias(name)).agg(F.bool_and(F.coalesce(F.col(ok).cast("boolean"), F.lit(False))).alias("ready"))
