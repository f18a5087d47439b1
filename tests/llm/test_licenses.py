import datetime

import pytest

from lucerna.llm import licenses as li

T = datetime.datetime(2024, 1, 1)
LIST = [("mit", "MIT License", ["MIT", "Expat"]), ("gpl-2.0", "GNU General Public License 2", ["GPL-2.0", "GPLv2"]), ("gpl-3.0", "GNU General Public License 3", ["GPL-3.0", "GPLv3"]), ("public-domain", "Public domain", ["PD"]),
        ("proprietary", "Proprietary, all rights reserved", []), ("cc-by-sa-4.0", "Creative Commons Attribution ShareAlike 4.0", ["CC-BY-SA-4.0"]), ("cc-by-4.0", "Creative Commons Attribution 4.0", ["CC-BY-4.0"])]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(LIST, "license_key string, license_name string, aliases array<string>")


def test_held_out_statements(spark, listed):
    want = {
        "SPDX-License-Identifier: MIT": "mit", "the code may be used under the MIT license": "mit", "Copyright (c) 2019 some body else, GPLv2.": "gpl-2.0", "(c) x_y 2011 - GPL-3.0-or-later": "gpl-3.0", "Licensed under CC BY 4.0.": "cc-by-4.0",
        "This shader is released under Creative Commons BY-SA 4.0.": "cc-by-sa-4.0", "I place this file in the public domain.": "public-domain", "Alle Rechte vorbehalten, anna 2014.": "proprietary", "GNU_GPL_version_3": "gpl-3.0",
        "idea seen in an MIT library, the code here is new": None, "a draft elsewhere was GPLv3, this one is not": None, "not derived from the GPL version of this effect": None, "license: tbd": None, "see LICENSE": None,
        "Code style: limit lines, permit tabs.": None, "Mit vielen Beispielen.": None, "Copyright (c) 2019 some body": None, "?": None, "Licensed under the Foo License 7.": None, "x" * 50_000: None}
    got = {r.statement: r.license_key for r in li.label_statements(spark.createDataFrame([(s,) for s in want], "statement string"), li.listed(listed)).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_statements_of_code_and_files():
    code = '/*{"CREDIT": "a", "LICENSE": "MIT"}*/\n/*\n * Licensed under\n * the MIT license.\n */\n// SPDX-License-Identifier: \\\n  MIT\nfloat a = 1.; // plain\n"MIT License"'
    look = li.hint(LIST)
    assert li.code_statements(code, look) == {"LICENSE: MIT", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"}
    assert li.code_statements("", look) == set() and li.code_statements("float x;", look) == set()
    assert "MIT License" in li.body_statements("# Title\n\nMIT License\n===========\n\nText that\nwraps.", look)


@pytest.mark.parametrize("url, want", [
    ("https://git.example/A/B-1/blob/main/x.fs", "a/b-1"), ("HTTPS://Git.Example/a/b.git#x", "a/b"), ("http://git.example/a/b?x=1", "a/b"), ("https://git.example/a", None), ("https://other.example/a/b", None), ("", None), (None, None)])
def test_repository(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(li.repository_of("u").alias("r")).first().r == want


def test_found(spark, listed):
    mit, gpl = "// License: MIT\n", "// License: GPLv2\n"
    records = spark.createDataFrame([("a", mit, None), ("a", mit, None), ("b", mit + gpl, ""), ("c", "x", "https://git.example/o/one/blob/x"), ("d", None, "https://git.example/o/two.git"), ("e", "", None), ("f", "// see LICENSE", "https://git.example/o/none"),
                                     ("g", mit, "https://git.example/o/two"), ("h", mit, None), (None, mit, None)], "shader_id string, code_image string, source_url string").selectExpr("*", "1 as unit", "'x' as finding")
    parents = spark.createDataFrame([("h", "GPLv3"), ("e", " tbd "), ("a", None), ("zz", "MIT"), (None, "MIT")], "shader_id string, license string")
    later = T + datetime.timedelta(1)
    files = spark.createDataFrame([
        (1, "o/one", "LICENSE", "MIT License", T), (2, "o/one", "LICENSE", "GPLv2", later), (3, "o/one", "vendor/LICENSE", "MIT", T), (4, "o/two", "LICENCE.txt", "MIT License", T), (5, "o/two", "README.md", "# x\n\nLicense: GPLv2\n", T), (6, "o/three", "a.txt", "MIT License", T),
        (7, "o/four", "COPYING", None, T), (8, None, "LICENSE", "MIT", T), (9, "o/five", None, "MIT", T)], "file_id long, repo string, file_path string, body string, fetched_at timestamp")
    got = {(r.unit, r.unit_key): r.finding for r in li.found(records, parents, files, listed).collect()}
    assert got == {("file", "a"): "mit", ("file", "b"): "conflict", ("file", "c"): "gpl-2.0", ("file", "d"): "conflict", ("file", "e"): "unknown", ("file", "f"): "unknown", ("file", "g"): "mit", ("file", "h"): "conflict",
                   ("repo", "o/one"): "gpl-2.0", ("repo", "o/two"): "conflict", ("repo", "o/three"): "unknown", ("repo", "o/four"): "unknown", ("repo", "o/five"): "unknown"}


def test_empty(spark, listed):
    records = spark.createDataFrame([("a", "// License: MIT", None)], "shader_id string, code_image string, source_url string")
    parents = spark.createDataFrame([], "shader_id string, license string")
    files = spark.createDataFrame([], "file_id long, repo string, file_path string, body string, fetched_at timestamp")
    assert [tuple(r) for r in li.found(records, parents, files, listed).collect()] == [("file", "a", "mit")]
    assert [tuple(r) for r in li.found(records, parents, files, listed.limit(0)).collect()] == [("file", "a", "unknown")]
    assert li.found(records.limit(0), parents, files, listed).count() == 0


def test_a_license_is_known_by_the_list_alone(spark, listed):
    texts = ["License: EPL-2.0", "Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "Released under Eclipse Public 2.0.", "EPL 2.0", "License: Foo-7.1", "Licensed under the Foo Bar License 7.1"]
    statements = spark.createDataFrame([(x,) for x in texts], "statement string")
    more = sorted([*LIST, ("epl-2.0", "Eclipse Public License 2.0", ["EPL-2.0"]), ("foo-7.1", "Foo Bar License 7.1", ["Foo-7.1"])])
    assert all(li.hint(more).search(x) for x in texts)
    assert {r.statement: r.license_key for r in li.label_statements(statements, more).collect()} == dict(zip(texts, ["epl-2.0"] * 5 + ["foo-7.1"] * 2))
    assert li.label_statements(statements, li.listed(listed)).count() == 0


def test_too_long_lists_are_refused(listed):
    with pytest.raises(ValueError):
        li.listed(listed, 3)


def test_names_follow_from_the_list():
    got = {tuple(li.tokens(n)) for n in li.names("gpl-2.0", "GNU General Public License 2", ["GPL-2.0", "GPLv2"])}
    assert {tuple(li.tokens(n)) for n in ("GNU GPL 2", "GPL version 2", "GPL-2.0-or-later", "GNU General Public License, version 2", "GPLv2+")} <= got
