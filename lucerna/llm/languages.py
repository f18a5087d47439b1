"""Problem 4: natural language in comments and string literals of source files.

Sentences are taken out of every file, reduced to distinct ones by a 128-bit hash, classified once each, and
their labels are joined back to weigh every file's characters by language. The classifier, multinomial naive
Bayes over character n-grams, is counted over the prose of all documents and their (partly wrong) labels.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.code_text import spans
from lucerna.plans.runtime import materialize, salted_join, spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "pl", "ru", "zh", "ja")
#: N-grams kept of each language: bounds the model that is broadcast.
GRAMS = 4000
#: Share of an n-gram that a language has not shown: the same for all, so that large samples are no handicap.
FLOOR = 1e-6
WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
KANA = re.compile(r"[぀-ヿ]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
END = re.compile(r"(?<=[.!?…])[\"')\]]*\s+(?=[^\W\d_a-zа-я]|\Z)|(?<=[。！？])")
CODE = re.compile(r"[;{}=<>\\|~^]|\w\(|\w\.\w|\w_\w|\+\+|--|&&|https?:|www\.|@\w+\.")
#: Addresses, calls and names within running words, and signs that prose has too: blanked before CODE is looked for.
FRAGMENT = re.compile(r"(?:https?:|www\.)\S+|\S+@\w+\.\S+|\b\w+\([^(){};=]{0,60}\)|\b\w+(?:[._]\w+)+\b|(?<=[^\W\d_]{2});(?=\s+[^\W\d_])|(?<=\s)\|(?=\s)")
CREDIT = re.compile(r"\s*(?:@(?:author|license|version|param|return|see|date)\b|(?:created|written|made|coded|ported)? ?by\b|authors?\b\s*:?|credits?\b|\(c\)|©|copyright\b|spdx\b)", re.I)
#: Words of license statements, which are left out: they are no prose of the file's author.
LICENSE = re.compile(
    r"licen[scz]|lizenz|licença|лиценз|ライセンス|许可|copyright|rights reserved|rechte vorbehalten|droits réservés|derechos reservados|direitos reservados|diritti riservati|prawa zastrzeżone"
    r"|права защищены|版权|public domain|gemeinfrei|\b(?:(?<!in )terms of|permission (?:is|notice|to (?:use|copy|modify|distribute|reuse))|(?:written|prior|without) permission|confidential|proprietary|no warranty|ohne gewähr|released under|reuse this file|apache|w?gpl\w*|lgpl\w*|bsd|mpl|zlib|cc0|cc[ -]by|creative commons)\b",
    re.I)
#: Names that are words or parts of words of a language in other letter case.
NAMED = re.compile(r"\b(?:MIT|CC|Expat|EXPAT)\b")
MARK = re.compile(r"^(?:[/*!\s#-]*)(?:@(?:brief|note|details?|todo|remark)\b\s*)?", re.I)


def json_strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, (list, dict)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from json_strings(v)


def passages(code: str) -> Iterator[str]:
    """Plain text of every comment and string literal: comment marks off, wrapped lines joined."""
    for kind, text in spans(code):
        if kind == "block" and text.lstrip()[:1] in ("{", "["):
            try:
                yield from json_strings(json.loads(text))
                continue
            except ValueError:
                pass
        lines = re.split(r"\\?(?:\r\n|\r|\n)", text)
        yield " ".join(x for x in (MARK.sub("", line).rstrip() if kind != "string" else line for line in lines) if x)


def is_sentence(text: str) -> bool:
    """Running words of a language: no switched-off code, name, tag, credit, address or key."""
    if CREDIT.match(text) or LICENSE.search(text) or (NAMED.search(text) and not text.isupper()):
        return False
    if CODE.search(text):
        rest = FRAGMENT.sub(" ", text)
        if CODE.search(rest) or 2 * len(rest.replace(" ", "")) < len(text.replace(" ", "")):
            return False
        text = rest
    if len(WIDE.findall(text)) >= 5:
        return True
    words = WORD.findall(text)
    letters = sum(map(len, words))
    return len(words) >= 4 and letters >= 0.7 * len(text.replace(" ", "")) and sum(len(w) > 1 for w in words) >= 3


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in END.split(text)) if s and is_sentence(s)]


def grams(text: str) -> list[str]:
    """Character n-grams of 1 to 4 letters with word edges; digits are left out."""
    low = " " + " ".join(WORD.findall(text.lower())) + " "
    n = len(low)
    return [low[i : i + k] for k in (1, 2, 3, 4) for i in range(n - k + 1) if low[i : i + k] != " "]


def file_sentences(records: DataFrame) -> DataFrame:
    """(shader_id, code_id, n_chars, hash, chars, text): one row per distinct sentence of a row's code. The text comes
    with the first row of a hash in each task only."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[bytes] = set()
        for batch in batches:
            rows = []
            for sid, code in zip(batch["shader_id"], batch["code_image"]):
                code_id = xxhash.xxh64_intdigest(code.encode("utf-8", "replace")) - (1 << 63)
                own: Counter = Counter()
                for passage in passages(code):
                    own.update(sentences(passage))
                for s, n in own.items():
                    key = hashlib.md5(s.encode("utf-8", "replace")).digest()
                    rows.append((sid, code_id, len(code), key, n * len(s), None if key in told or told.add(key) else s))
            if rows:
                yield pd.DataFrame(rows, columns=["shader_id", "code_id", "n_chars", "hash", "chars", "text"])

    coded = records.filter(F.col("shader_id").isNotNull() & (F.length("code_image") > 0)).select("shader_id", "code_image")
    return spread(coded).mapInPandas(scan, "shader_id string, code_id long, n_chars int, hash binary, chars int, text string")


def train(documents: DataFrame, most: int = GRAMS) -> dict:
    """{gram: log probabilities in order of LANGUAGES} and priors, counted over the prose of all documents.

    Labels are taken without letter case and white space; other labels are left out. The ``most`` commonest
    n-grams of each language are kept.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"]):
                for line in re.split(r"[\r\n]+", text):
                    seen.update((lang, s) for s in sentences(line.split(": ", 1)[-1]))
            if seen:
                yield pd.DataFrame({"lang": [k[0] for k in seen], "text": [k[1] for k in seen], "n": list(seen.values())})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text, n in zip(batch["lang"], batch["text"], batch["n"]):
                for g in grams(text):
                    seen[lang, g] += n
            if seen:
                yield pd.DataFrame({"lang": [k[0] for k in seen], "gram": [k[1] for k in seen], "n": list(seen.values())})

    labelled = documents.select(F.lower(F.trim("lang")).alias("lang"), "text").filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    prose = spread(labelled).mapInPandas(cut, "lang string, text string, n long").groupBy("lang", "text").agg(F.sum("n").alias("n"))
    counts = prose.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= most)
    table: dict[str, list[float]] = {}
    totals = dict.fromkeys(LANGUAGES, 0)
    rows = top.select("lang", "gram", "n").collect()
    for lang, _, n in rows:
        totals[lang] += n
    for lang, gram, n in rows:
        table.setdefault(gram, [0.0] * len(LANGUAGES))[LANGUAGES.index(lang)] = n
    return {g: [math.log(max(c / max(totals[lang], 1), FLOOR)) for c, lang in zip(row, LANGUAGES)] for g, row in table.items()}


def classify(text: str, model: dict) -> str:
    """The language of a sentence; scripts that name it decide at once."""
    wide = len(WIDE.findall(text))
    if wide >= 5 and wide >= 0.3 * len(text):
        return "ja" if KANA.search(text) else "zh"
    score = [0.0] * len(LANGUAGES)
    hits = 0
    for g in grams(text):
        if row := model.get(g):
            hits += 1
            score = [a + b for a, b in zip(score, row)]
    if not hits:
        return ""
    return LANGUAGES[score.index(max(score))]


def shares(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(shader_id, lang, chars, n_chars, share): each language's part of a file's characters.

    Null and empty code give no row; equal rows of a shader_id give one. A sentence in a third of all files is
    labelled once, and its label is joined back by salted keys.
    """
    model = train(documents)
    shared = records.sparkSession.sparkContext.broadcast(model)
    own = materialize(file_sentences(records))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            yield pd.DataFrame({"hash": batch["hash"], "lang": [classify(t, model) for t in batch["text"]]})

    labels = own.filter("text is not null").groupBy("hash").agg(F.min("text").alias("text")).mapInPandas(label, "hash binary, lang string")
    weights = materialize(own.select("shader_id", "code_id", "n_chars", "hash", "chars").distinct())
    weighed = salted_join(weights, labels, "hash", "shader_id")
    by = weighed.filter("lang <> ''").groupBy("shader_id", "code_id", "n_chars", "lang").agg(F.sum("chars").alias("chars"))
    return by.groupBy("shader_id", "lang").agg(F.max(F.struct((F.col("chars") / F.col("n_chars")).alias("share"), "chars", "n_chars")).alias("m")).select(
        "shader_id", "lang", "m.chars", "m.n_chars", "m.share")


def found(records: DataFrame, documents: DataFrame, least: float = 0.05) -> DataFrame:
    """p4_found: (shader_id, lang) where sentences of the language are at least ``least`` of the file."""
    return shares(records, documents).filter(F.col("share") >= least).select("shader_id", "lang")
