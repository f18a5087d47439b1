import pytest
from pyspark.sql import functions as F

from lucerna.functions import functions_of_code as fc
from lucerna.functions import text as tx
from lucerna.functions.code_text import spans, without_comments


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()[0]


@pytest.mark.parametrize("value, want", [
    ("sdSphere", ["sdsphere", "sd", "sphere"]), ("HTTPServer2Go", ["httpserver2go", "http", "server2", "go"]), ("map_scene", ["mapscene", "map", "scene"]),
    ("noise", ["noise", "noise"]), ("void a x float", []), ("噪声", []), ("", []), (None, []), ("iTime", ["itime", "time"])])
def test_search_terms(spark, value, want):
    assert one(spark, value, tx.search_terms("t")) == want


@pytest.mark.parametrize("value, want", [("", 0), (None, 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\r\n", 2), ("\n\n", 2)])
def test_line_count(spark, value, want):
    assert one(spark, value, tx.line_count("t")) == want


@pytest.mark.parametrize("value, want", [("a/B c.glsl", "local_a_b_c"), ("PixelFlow/data/shader.frag", "local_pixelflow_data_shader"), ("--.x", "local_unnamed"), ("", "local_unnamed")])
def test_slug(spark, value, want):
    assert one(spark, value, tx.slug("t")) == want


def test_clip_and_brief(spark):
    assert one(spark, "abc  def", tx.clip("t", 5)) == "abc\n// ..."
    assert one(spark, "ab", tx.clip("t", 5)) == "ab"
    assert one(spark, "a\nb" * 50, tx.brief("t", 5)) == "a ba ..."


def test_comments():
    code = 'a // x \\\n y\nb /* c */ "s // t" /* open'
    assert without_comments(code).split() == ["a", "b", '"s', "//", 't"']
    assert [k for k, _ in spans(code)] == ["line", "block", "string", "block"]
    assert without_comments("") == "" and without_comments("a/b") == "a/b"


def test_functions():
    code = "float f(vec2 p){ if(p.x>0.){ return 1.; } return 0.; }\nvoid g(){ f(p);\nfloat f(){}"
    got = fc.functions(code)
    assert [x["name"] for x in got] == ["f", "g", "f"]
    assert got[0]["body"].endswith("return 0.; }") and got[0]["signature"] == "float f(vec2 p)"
    assert got[1]["body"].endswith("f(){}"), "an open body reaches the end"
    assert fc.functions(None) == [] and fc.functions("else if (x) { }") == []
    assert fc.sections("int a;\nfloat f(){ return 1.; }\nint b;") == {"globals": "int a;\n\nint b;", "f": "float f(){ return 1.; }"}


def test_function_chunks(spark):
    from lucerna.operators.chunking import chunks
    from lucerna.schema import as_records

    body = "float f(){ " + "x;" * 700 + " }"
    df = as_records(spark.createDataFrame([("s", "n", body + "\nfloat f(){}\nvoid mainImage(){}"), ("e", "n", None)], "shader_id string, name string, code_image string"))
    got = {r.chunk_id: r.text for r in chunks(df).collect()}
    assert set(got) == {"s::overview", "s::structure", "s::fn::f", "s::fn::f_1", "s::fn::mainImage", "s::full_code", "e::overview", "e::structure"}
    assert got["s::fn::f"].endswith("\n// ...") and "Functions: none" in got["e::structure"] and "mainImage present" in got["s::structure"]
    assert F is not None
