"""Problem 3: the license of every source file and repository.

Statements are cut out of comments, license fields and repository files. A multinomial logistic regression over word
n-grams labels each distinct statement once. It is trained on variants of general templates: names that follow by rule
from the license list, put into statements, and into remarks that state nothing. Open set: licenses that are not
listed and names of nobody knows what are trained as no statement, and labels of low probability, or of a name of
which the text has no variant whole, are rejected. The labels of a file, its record and its repository are reconciled.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions.code_text import spans
from lucerna.llm.languages import END, MARK
from lucerna.plans.runtime import materialize, salted_join, spread

NONE = "none"
#: Names of a license that a template is trained with.
EACH = 10
#: Tasks of the training: its rows are few, and each task sends a whole gradient at each step.
TASKS = 4
#: Words and numbers; letters and digits are apart only in what may be a license's short name, not in names of people.
TOKEN = re.compile(r"(?<![^\W_])(?:l?gpl|mpl|apache|bsd|cc|asl)(?:v(?=\d))?(?=\d)|(?<=[a-z])\d+(?![^\W\d_])|[^\W\d_](?:[^\W_])*|\d+")
#: Token that stands for people's names in the templates, and for every run of words no template has.
SOMEONE = "name"
#: General statement templates; X is a name of a license, A an author, Y a year.
STATED = (
    "X", "X.", "(X)", "license: X", "License: X", "Licence: X", "@license X", "SPDX-License-Identifier: X", "Licensed under X", "Licensed under the X.", "licensed under the terms of the X", "This work is licensed under a X.",
    "This software is released under the X", "released under X", "It is published under X.", "distributed under the terms of X", "under the terms of X, no warranty", "Distributed under the X, without any warranty.", "available under the X", "made available under X, as is", "This file is covered by the X",
    "The whole folder is covered by: X", "subject to the terms of the X", "you can redistribute it and/or modify it under the terms of the X", "You may copy and reuse this under X", "Use of this source code is governed by the X", "governed by X, see below", "may be used according to X", "X/A license", "X (A)", "according to the X",
    "free to share and to adapt as the X allows", "Terms: X", "terms of use: X", "Terms of use - X", "The license is X", "X applies to all files here", "License X applies.", "The project is X licensed", "X licensed", "Everything here is under X", "All code is X", "We use the X.", "X, see the header", "X (see file)",
    "Copyright (c) Y A. Licensed under X", "Copyright (c) Y A, X", "Copyright (c) Y A and others, X.", "Copyright Y A and anyone else, X", "Copyright (c) Y A, X.", "Copyright Y A. X", "(c) Y A - X", "(c) A Y - X", "© A Y, X", "X Copyright (c) Y A", "X (c) Y A", "by A, X", "A Y X",
    "Lizenz: X", "Lizenziert unter X", "Veröffentlicht unter der X", "Diese Datei steht unter X.", "Das Programm steht unter der X.", "Freigegeben unter X, ohne Gewähr", "Licence : X", "Distribué sous licence X", "Ce code est publié sous X.", "Licencia: X", "Publicado bajo X", "Este código se distribuye bajo la licencia X.",
    "Licença: X", "Publicado sob X", "Este código é distribuído sob a licença X.", "Licenza: X", "Distribuito con licenza X", "Questo codice è rilasciato sotto la X.", "rilasciato sotto X", "Licencja: X", "Udostępniono na licencji X", "Ten kod jest dostępny na X.", "Лицензия: X", "Распространяется под лицензией X", "Код доступен по X.",
    "ライセンス: X", "X で公開しています", "このコードは X ライセンスです。", "许可证：X", "许可：X", "本作品采用 X 许可", "按 X 发布", "代码以 X 发布。",
)
#: Whole statements that the public domain or all rights reserved are often made by, without a name.
WHOLE = {
    "public-domain": (
        "public domain", "in the public domain", "released into the public domain", "This work is in the public domain.", "dedicated to the public domain", "placed in the public domain by A", "I, A, waive all rights: public domain", "Public domain, no rights reserved", "public domain: do as you want", "Public domain, free for any use", "No copyright, public domain", "no copyright here, dedicated to the public domain", "gemeinfrei", "Dieses Werk ist gemeinfrei.", "dans le domaine public",
        "en el dominio público", "em domínio público", "nel pubblico dominio", "w domenie publicznej", "в общественном достоянии", "общественное достояние", "公有领域", "属于公有领域", "パブリックドメイン"),
    "proprietary": (
        "All rights reserved", "All rights reserved.", "all rights reserved by A", "Copyright (c) Y A. All rights reserved.", "(c) A, all rights reserved Y", "proprietary", "Proprietary and confidential", "This is proprietary code of A", "confidential", "Confidential: property of A", "strictly confidential, A Y",
        "Do not copy or distribute", "No permission to copy", "No permission is given to use, copy or change this code", "may not be copied without written permission of A", "Unauthorized copying is prohibited", "internal use only, no copies", "Alle Rechte vorbehalten", "A, alle Rechte vorbehalten", "Tous droits réservés", "A, tous droits réservés Y", "Todos los derechos reservados",
        "Todos os direitos reservados", "Tutti i diritti riservati", "Wszelkie prawa zastrzeżone", "Все права защищены", "版权所有，保留所有权利", "保留所有权利", "無断転載禁止", "無断複製を禁じます"),
}
#: General remarks on other works, denials and open questions; they state nothing.
REMARKS = (
    "this is not X", "not X", "not under X", "not licensed under X", "never released under the X", "no longer X", "no X code in here", "does not contain X code", "without any X code", "not taken from the X release", "not derived from the X code", "not based on the X version", "independent of the X version", "not a copy of the X one",
    "the original was X", "the first draft was X", "an older draft was X, this one isn't", "a version elsewhere was X, not this one", "an earlier version was X", "was X once", "used to be X", "unlike the X original", "unlike the X version of this", "compare with the X version", "see also the X port by A", "similar to the X implementation by A", "there is an X version by A",
    "inspired by an X shader, written from scratch", "based on an idea of an X project, new code", "the idea comes from an X library, rewritten here", "saw this in an X library, no code copied", "seen in an X demo, the code here is my own", "an X library does the same", "the library next door is X", "the tool is X", "uses a tool that is X", "the font is X, not this file", "an effect of that name exists as X",
    "maybe X", "maybe X later", "X?", "should this be X?", "would X fit?", "is X ok?", "X or something else", "X or A, not decided", "consider X", "TODO: decide on X", "todo ask whether X fits", "we may switch to X one day", "could become X some day", "under discussion: X", "thinking about X",
    "nicht X", "nicht unter X", "vielleicht X", "das Original war X", "pas sous X", "peut-être X", "l'original était X", "no es X", "quizás X", "não é X", "talvez X", "non è X", "forse X", "nie jest X", "może X", "это не X", "возможно X", "不是 X", "也许 X", "X ではありません",
)
SILENT = (
    "license", "License", "LICENSE", "licence", "license: tbd", "license: todo", "license: unknown", "license: none", "License not decided", "license to be decided", "License pending", "license unknown", "unknown license", "unknown", "no license", "no license yet", "without license", "license?", "which license?", "which license applies here?", "see LICENSE", "see the license file", "See LICENSE.txt for the terms",
    "see file", "tbd", "todo", "n/a", "none", "-", "?", "ask the author", "ask A first", "check with the author", "todo: ask about the license", "license check before release", "permission pending", "waiting for permission", "ask for permission", "Copyright (c) Y A", "Copyright Y A", "(c) Y A", "© A", "by A", "by A Y", "written by A in Y", "created by A", "Author: A", "thanks to A",
    "terms", "terms of use", "Terms and conditions apply", "these terms", "The terms below apply to all files", "You may use, copy and change this as long as this notice stays", "as is, without warranty", "No warranty of any kind", "no promise of any kind", "Please ask before use", "The above notice must stay in all copies",
    "limit the steps", "the limit is soft", "permit some overshoot", "the edges permit it", "submit it", "code style: limit and permit", "a public function", "general idea", "the new version", "all lights", "zero is black", "common case", "creative use of noise", "attribution of the light", "domain warp", "the domain repeats", "clause by clause", "by the light", "new", "2", "3.0", "version 2", "v3",
    "mit Licht und Schatten", "Mit einem Schatten am Rand", "wird mit der Zeit heller", "zusammen mit dem Rand", "nur mit wenigen Schritten", "ein Effekt mit vielen Farben", "Mit der Kamera", "A mit A und A", "Lizenz offen", "Lizenz: unbekannt", "Licence à définir", "Licencia por decidir", "Licença a definir", "Licenza da decidere", "Licencja nieznana", "Лицензия не решена", "лицензия неизвестна", "许可证待定", "许可未知", "ライセンス未定",
)
#: Known licenses beyond the list, trained as no statement of a listed one unless they are listed.
OTHERS = (
    ("EPL-2.0", "Eclipse Public License 2.0"), ("BSL-1.0", "Boost Software License 1.0"), ("ISC", "ISC License"), ("Artistic-2.0", "Artistic License 2.0"), ("EUPL-1.2", "European Union Public License 1.2"), ("CDDL-1.0", "Common Development and Distribution License 1.0"),
    ("AGPL-3.0", "GNU Affero General Public License 3"), ("GPL-1.0", "GNU General Public License 1"), ("LGPL-2.0", "GNU Library General Public License 2"), ("LGPL-3.0", "GNU Lesser General Public License 3"), ("GFDL-1.3", "GNU Free Documentation License 1.3"), ("OFL-1.1", "SIL Open Font License 1.1"), ("MS-PL", "Microsoft Public License"),
    ("MPL-1.1", "Mozilla Public License 1.1"), ("Apache-1.1", "Apache License 1.1"), ("BSD-4-Clause", "BSD 4-Clause License"), ("0BSD", "Zero-Clause BSD"), ("WTFPL", "Do What The Fuck You Want To Public License"), ("Unlicense", "The Unlicense"), ("NCSA", "University of Illinois/NCSA Open Source License"), ("PSF-2.0", "Python Software Foundation License 2.0"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution NoDerivatives 4.0"), ("CC-BY-NC-ND-4.0", "Creative Commons Attribution NonCommercial NoDerivatives 4.0"), ("CC-BY-3.0", "Creative Commons Attribution 3.0"), ("CC-BY-SA-3.0", "Creative Commons Attribution ShareAlike 3.0"), ("CC-BY-NC-SA-4.0", "Creative Commons Attribution NonCommercial ShareAlike 4.0"),
)
#: Words, in ten languages, of which a passage has one, or a name of the list, to be read as a statement.
WORDS = (
    r"licen[scz]|lizenz|licença|лиценз|ライセンス|许可|copyright|©|\(c\)|spdx|rights? reserved|rechte vorbehalten|droits réservés|derechos reservados|direitos reservados|diritti riservati|prawa zastrzeżone|права защищены|版权|权利|無断|著作"
    r"|public.?domain|gemeinfrei|domaine public|dominio público|domínio público|pubblico dominio|domen\w+ publiczn|достояни|公有领域|パブリックドメイン|terms of|proprietary|confidential|permission|prohibited|redistribut|(?:released|published|distributed|available|covered|governed) (?:under|by)|unter der")
#: Words of names that say nothing alone.
VAGUE = frozenset("the a an license licence licensed terms version v of and or to only later see style universal international unported c name yyyy".split())
NUMBERS = {"1": "one", "2": "two", "3": "three", "4": "four"}


def names(key: str, name: str, aliases: list[str]) -> list[str]:
    """Ways to write the name of a license, by rule: its key, name and aliases with and without the word license, versions
    in several notations, hyphens as blanks, numbers as words, GNU and Creative Commons before their short names."""
    out = dict.fromkeys([name, key, *aliases])
    whole = name.split(",")[0]
    out[whole] = None
    for n in [name, key, *aliases]:
        out[re.sub(r"\s+licen[sc]e\b", "", n, flags=re.I)] = None
    if name.startswith("GNU ") or name.startswith("Creative Commons "):
        first = "GNU " if name.startswith("GNU ") else "Creative Commons "
        for n in [key, *aliases]:
            out[first + re.sub(r"(?i)^cc-?", "", n).replace("-", " ")] = None
            out[first + re.sub(r"(?i)^cc-?", "", n)] = None
    if name.startswith("Creative Commons "):
        out[name.replace("Creative Commons", "CC")] = None
        body = name.removeprefix("Creative Commons ").split(" ")
        out["Creative Commons " + "-".join(body[:-1]) + " " + body[-1]] = None
        out["Creative Commons " + re.sub(r"([a-z])([A-Z])", r"\1 \2", name.removeprefix("Creative Commons "))] = None
    out[name.replace("General Public License", "GPL")] = None
    for n in list(out):
        if not re.search(r"licen[sc]e", n, re.I):
            out[n + " license"] = None
        out[n.replace("-", " ")] = None
        out[re.sub(r"-(?=[\d.]+$)", " ", n)] = None
    for n in list(out):
        if m := re.fullmatch(r"(.*?)[\s-]*\bv?(\d+(?:\.\d+)?)(\+?)", n):
            stem, number = m[1].strip(" ,-"), m[2]
            if stem and not re.search(r"clause", stem, re.I):
                short = number.removesuffix(".0")
                forms = {number, short} | ({number + ".0"} if "." not in number else set())
                for v in forms:
                    for form in ("{} {}", "{}-{}", "{} v{}", "{} v. {}", "{} version {}", "{}, version {}", "{}, v{}", "{}v{}" if re.fullmatch(r"[A-Z]+", stem) or stem.endswith("GPL") else "{} {}", "{}{}" if re.fullmatch(r"[A-Z]+", stem) else "{} {}"):
                        out[form.format(stem, v)] = None
                if re.search(r"GPL$", stem):
                    for v in forms:
                        out |= dict.fromkeys([f"{stem}-{v}-only", f"{stem}-{v}-or-later", f"{stem}v{v}+", f"{stem} {v}+", f"{stem} {v} or later"])
                for tail in (" Universal",) if "Zero" in stem or stem.upper().startswith("CC0") else (" International", " Unported") if name.startswith("Creative") else ():
                    out[f"{stem} {number}{tail}"] = None
                if stem.endswith("Zero") or stem.upper() == "CC0":
                    out[stem] = None
    for n in list(out):
        if m := re.search(r"\b([1-4])([- ]clause)s?\b", n, re.I):
            word = NUMBERS[m[1]]
            base = (n[: m.start()] + n[m.end() :]).strip()
            family = re.sub(r"\s+", " ", re.sub(r"(?i)\blicen[sc]e\b", "", base)).strip()
            out |= dict.fromkeys([f"{word}-clause {family}", f"{word} clause {family}", f"{m[1]}-clause {family} license", f"{family} ({word} clauses)", f"{family} with {word} clauses", f"{family} {m[1]} clause"])
    return list({tuple(tokens(n)): n for n in reversed(out) if tokens(n)}.values())


def tokens(text: str) -> list[str]:
    """Lower-case words and numbers, letters and digits apart; years are one token, and so are both spellings of license."""
    return ["yyyy" if re.fullmatch(r"(?:19|20)\d\d", t) else "license" if t == "licence" else t for t in TOKEN.findall(text.lower())]


def grams(text: str, known: frozenset[str] | None = None) -> list[str]:
    """Word n-grams of 1 to 3 words with the text's edges; a run of words not in ``known`` counts as a name."""
    words = ["<"]
    for t in tokens(text):
        t = t if known is None or t in known else SOMEONE
        if t != SOMEONE or words[-1] != SOMEONE:
            words.append(t)
    words.append(">")
    return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def hint(licenses: list[tuple[str, str, list[str]]]) -> re.Pattern:
    """What a passage must have to be read: a word of WORDS, or the first two telling words of a listed name."""
    heads = sorted({tuple([t for t in tokens(n) if t not in VAGUE][:2]) for x in licenses for n in names(*x)})
    between = r"[\W_]*(?:(?:the|licen[sc]e|version|v)\b[\W_]*|v(?=\d))?"
    return re.compile(WORDS + "|(?<![^\\W_])(?:" + "|".join(between.join(map(re.escape, h)) for h in heads if h) + r")(?![^\W\d_])", re.I)


def sentences(passage: str, hint: re.Pattern) -> Iterator[str]:
    for s in END.split(passage):
        s = re.sub(r"\s+", " ", s or "").strip()
        if s and hint.search(s):
            yield s


def fields(value, name: str = "") -> Iterator[str]:
    """Strings of a JSON value, those under a name of a license field with that name before them."""
    if isinstance(value, str):
        yield f"{name}: {value}" if re.search("licen", name, re.I) and not re.search("licen", value, re.I) else value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from fields(v, str(k))
    elif isinstance(value, list):
        for v in value:
            yield from fields(v, name)


def code_statements(code: str, hint: re.Pattern) -> set[str]:
    out: set[str] = set()
    if not hint.search(code):
        return out
    for kind, text in spans(code):
        if not text or kind == "string":
            continue
        if kind == "block" and text.lstrip()[:1] in ("{", "["):
            try:
                for passage in fields(json.loads(text)):
                    out.update(sentences(passage, hint))
                continue
            except ValueError:
                pass
        out.update(sentences(" ".join(x for x in (MARK.sub("", line).strip() for line in re.split(r"\\?(?:\r\n|\r|\n)", text)) if x), hint))
    return out


def body_statements(body: str, hint: re.Pattern) -> set[str]:
    """Statements of a repository's text file: headings and paragraphs, wrapped lines joined."""
    out: set[str] = set()
    for block in re.split(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)", body):
        part: list[str] = []
        for line in re.split(r"\r\n|\r|\n", block):
            if re.fullmatch(r"\s*[=\-~_*#]{3,}\s*", line):
                out.update(sentences(" ".join(part), hint))
                part = []
            else:
                part.append(re.sub(r"^[\s#>*-]+|\*\*", "", line))
        out.update(sentences(" ".join(part), hint))
    return out


def filled(template: str, name: str) -> str:
    return re.sub(r"\bX\b", lambda _: name, re.sub(r"\bA\b", SOMEONE, re.sub(r"\bY\b", "2015", template)))


def training_rows(licenses: list[tuple[str, str, list[str]]]) -> list[tuple[str, str]]:
    """(label, text): the bounded training set, each template with up to EACH names of a license in turn."""
    rows: list[tuple[str, str]] = []
    for key, name, aliases in licenses:
        ways = names(key, name, aliases)
        step, often = -(-len(ways) // EACH), max(1, EACH // len(ways))
        for i, n in enumerate(ways):
            rows += [(key, filled(t, n)) for k, t in enumerate(STATED) if (i + k) % step == 0 or k < 4 for _ in range(often)]
            rows += [(NONE, filled(t, n)) for k, t in enumerate(REMARKS) if (i + k) % step == 0 for _ in range(often)]
        rows += [(key, filled(t, "")) for t in WHOLE.get(key, ()) for _ in range(20)]
    taken = {tuple(tokens(n)) for x in licenses for n in names(*x)}
    for key, name in OTHERS:
        for n in dict.fromkeys([key, name, key.replace("-", " "), name.replace(" License", "")]):
            if tuple(tokens(n)) not in taken:
                rows += [(NONE, filled(t, n)) for t in STATED]
    for n in (SOMEONE, f"{SOMEONE} license", f"{SOMEONE} public license", f"{SOMEONE} license 1.0", f"{SOMEONE} 2.0", f"{SOMEONE} license version 3", f"{SOMEONE} 4.0"):
        rows += [(NONE, filled(t, n)) for t in STATED for _ in range(3)]
    return rows + [(NONE, filled(t, "")) for t in SILENT for _ in range(20)]


_TRAINED: dict = {}


def listed(licenses: DataFrame, most_licenses: int = 1000) -> list[tuple[str, str, list[str]]]:
    """(key, name, aliases) of the license list, refused beyond ``most_licenses``; a null name is the key."""
    rows = licenses.select("license_key", "license_name", "aliases").filter("license_key is not null").limit(most_licenses + 1).collect()
    if len(rows) > most_licenses:
        raise ValueError(f"more than {most_licenses} licenses")
    return sorted((r[0], r[1] or r[0], [a for a in r[2] or [] if a]) for r in rows)


def trained(spark: SparkSession, licenses: list[tuple[str, str, list[str]]]):
    """(vocabulary model, regression, labels, words known) for a license list; trained once in a session."""
    at = (spark.sparkContext.applicationId, repr(licenses))
    if at not in _TRAINED:
        labels = [NONE, *dict.fromkeys(x[0] for x in licenses)]
        examples = training_rows(licenses)
        known = frozenset(t for _, text in examples for t in tokens(text))
        weights = Counter((label, tuple(grams(text, known))) for label, text in examples)
        rows = [(float(labels.index(label)), list(g), float(n)) for (label, g), n in weights.items()]
        train = spark.createDataFrame(pd.DataFrame(rows, columns=["label", "grams", "weight"]), "label double, grams array<string>, weight double").repartition(TASKS).cache()
        counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=1 << 16, binary=True).fit(train)
        model = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0003, maxIter=60).fit(counter.transform(train))
        train.unpersist()
        _TRAINED.clear()
        _TRAINED[at] = (counter, model, labels, known)
    return _TRAINED[at]


def told(licenses: list[tuple[str, str, list[str]]]) -> dict[str, list[frozenset[str]]]:
    """The telling words of each variant of a license's name, and of its whole statements."""
    out: dict[str, list[frozenset[str]]] = {}
    for key, name, aliases in licenses:
        texts = [*names(key, name, aliases), *WHOLE.get(key, ())]
        sets = {frozenset(t for t in tokens(filled(x, "")) if t not in VAGUE) for x in texts}
        out[key] = out.get(key, []) + [s for s in sets if s]
    return out


def label_statements(statements: DataFrame, licenses: list[tuple[str, str, list[str]]], least: float = 0.5) -> DataFrame:
    """(statement, license_key) for distinct statements that state a license.

    Open set: a statement is rejected where the best class is no license, has a probability under ``least``, or where
    no way to write the license's name is whole in the text.
    """
    counter, model, labels, known = trained(statements.sparkSession, licenses)
    variants = told(licenses)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [frozenset(tokens(s)) for s in batch["statement"]]
            whole = [[k for k, sets in variants.items() if any(v <= w for v in sets)] for w in words]
            yield pd.DataFrame({"statement": batch["statement"], "grams": [grams(s, known) for s in batch["statement"]], "whole": whole})

    read_ones = statements.select("statement").mapInPandas(read, "statement string, grams array<string>, whole array<string>").filter("size(whole) > 0")
    scored = model.transform(counter.transform(read_ones)).withColumn("license_key", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1))
    sure = (F.col("license_key") != NONE) & (F.array_max(vector_to_array("probability")) >= least) & F.array_contains("whole", F.col("license_key"))
    return scored.filter(sure).select("statement", "license_key")


def repository_of(url) -> F.Column:
    """owner/name in lower case that follow the host git.example, null for other addresses."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?git\.example(?::\d+)?/([^/?#\s]+/[^/?#\s]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.git$", ""), F.lit(""))


def verdict(keys) -> F.Column:
    return F.when(F.size(keys) > 1, F.lit("conflict")).when(F.size(keys) == 1, keys[0])


def found(records: DataFrame, parents: DataFrame, repo_files: DataFrame, licenses: DataFrame) -> DataFrame:
    """p3_found: (unit, unit_key, finding), one row per shader_id of the records and per repo of the files.

    Null code, license, body, path or address states nothing; units without a key have no row. Repository:
    license files and READMEs of the top folder, each path's latest version (latest fetched_at, then file_id).
    """

    def from_code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, s) for i, code in zip(batch["shader_id"], batch["code_image"]) for s in code_statements(code, look)]
            if rows:
                yield pd.DataFrame(rows, columns=["unit_key", "statement"])

    def from_body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, s) for i, body in zip(batch["repo"], batch["body"]) for s in body_statements(body, look)]
            if rows:
                yield pd.DataFrame(rows, columns=["unit_key", "statement"])

    schema = "unit_key string, statement string"
    known = listed(licenses)
    look = hint(known)
    coded = spread(records.filter("shader_id is not null and code_image is not null").select("shader_id", "code_image"))
    of_code = coded.mapInPandas(from_code, schema)
    of_parent = parents.filter("shader_id is not null and license is not null").select(F.col("shader_id").alias("unit_key"), F.trim(F.regexp_replace("license", r"\s+", " ")).alias("statement")).filter("statement <> ''")
    files = repo_files.filter("repo is not null and file_path is not null")
    latest = files.groupBy("repo", "file_path").agg(F.max_by("body", F.struct("fetched_at", "file_id")).alias("body"))
    top = latest.filter(F.col("body").isNotNull() & F.lower("file_path").rlike(r"^(?:licen[sc]e|copying|unlicense|readme)(?:[.-][^/]*)?$"))
    of_repo = top.select("repo", "body").mapInPandas(from_body, schema)
    stated = materialize(of_code.withColumn("unit", F.lit("file")).unionByName(of_parent.withColumn("unit", F.lit("file"))).unionByName(of_repo.withColumn("unit", F.lit("repo"))).distinct())
    labels = label_statements(stated.select("statement").distinct(), known)
    keys = salted_join(stated, labels, "statement", "unit_key").groupBy("unit", "unit_key").agg(F.array_sort(F.collect_set("license_key")).alias("keys"))
    keys = keys.select("unit", "unit_key", verdict(F.col("keys")).alias("stated"))
    repos = repo_files.filter("repo is not null").select(F.col("repo").alias("unit_key")).distinct().join(keys.filter("unit = 'repo'").drop("unit"), "unit_key", "left")
    repos = repos.select(F.lit("repo").alias("unit"), "unit_key", F.coalesce("stated", F.lit("unknown")).alias("finding"))
    repos = materialize(repos)
    units = records.filter("shader_id is not null").groupBy(F.col("shader_id").alias("unit_key")).agg(F.max(repository_of(F.col("source_url"))).alias("repo"))
    own = units.join(keys.filter("unit = 'file'").drop("unit"), "unit_key", "left")
    of_folder = repos.select(F.col("unit_key").alias("repo"), F.col("finding").alias("inherited"))
    settled = own.filter("stated is not null or repo is null").select("unit_key", F.coalesce("stated", F.lit("unknown")).alias("finding"))
    asked = salted_join(own.filter("stated is null and repo is not null"), of_folder, "repo", "unit_key", "left").select("unit_key", F.coalesce("inherited", F.lit("unknown")).alias("finding"))
    filed = settled.unionByName(asked).select(F.lit("file").alias("unit"), "unit_key", "finding")
    return filed.unionByName(repos)


def findings(records: DataFrame, parents: DataFrame, repo_files: DataFrame, licenses: DataFrame) -> DataFrame:
    """(unit, finding, units): how many files and repositories each finding has."""
    return found(records, parents, repo_files, licenses).groupBy("unit", "finding").agg(F.count("*").alias("units"))
