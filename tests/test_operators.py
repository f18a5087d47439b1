import math

import pytest
from pyspark.sql import functions as F

from lucerna.operators import analysis, cleaning, evaluation, messages, rules, search
from lucerna.schema import as_records

CODE = "void mainImage(out vec4 fragColor, in vec2 fragCoord){ fragColor = vec4(1.); }"


def records(spark, rows):
    fields = "row_id long, shader_id string, source string, likes int, code_image string, has_external_assets boolean"
    return as_records(spark.createDataFrame(rows, fields)).withColumn("row_id", F.monotonically_increasing_id()) if not rows else as_records(spark.createDataFrame(rows, fields)).join(
        spark.createDataFrame([(r[0], r[1]) for r in rows], "row_id long, shader_id string"), "shader_id")


def test_clean_reasons(spark):
    long = "x" * 200
    df = records(spark, [(1, "a", "shadertoy", 30, long, False), (2, "b", "shadertoy", 29, long, False), (3, "c", "seed", 0, "x", True), (4, "d", "local", 0, "y", True), (5, "e", "shadertoy", 99, "z" * 199, False),
                         (6, "f", "shadertoy", 99, "z" * 12001, False), (7, "g", "shadertoy", 99, "", False), (8, "h", "shadertoy", 31, long, False), (9, "i", "isf", 0, long, False), (10, "j", "shadertoy", 99, "w" * 12000, False)])
    got = {r.shader_id: r.drop_reason for r in cleaning.clean(df).collect()}
    assert got == {"a": None, "b": "likes", "c": None, "d": "external", "e": "length", "f": "length", "g": "no_image", "h": "duplicate", "i": "duplicate", "j": None}


def test_clean_uses_last_pass(spark):
    df = spark.createDataFrame([(1, [("Image", "one"), ("image", "two"), ("Common", "c")], "seed")], "row_id long, p array<struct<t:string,c:string>>, source string")
    df = df.withColumn("passes", F.transform("p", lambda x: F.struct(F.lit("n").alias("name"), x["t"].alias("type"), x["c"].alias("code"), F.array().cast("array<map<string,string>>").alias("inputs"), F.array().cast("array<map<string,string>>").alias("outputs"))))
    df = df.selectExpr("row_id", "source", "passes", "'' code_image", "'' code_common", "false has_external_assets", "0 likes")
    r = cleaning.with_code(df).first()
    assert (r.image, r.common, r.code) == ("two", "c", "two")


def test_quota_prefers_reference_rows_then_quality(spark):
    rows = [(1, ["t"], False, 0.9), (2, ["t"], True, 0.1), (3, ["t"], False, float("nan")), (4, ["uncategorized", "t"], False, 0.9), (5, None, False, 0.5), (6, ["t"], False, None)]
    df = spark.createDataFrame(rows, "row_id long, tags_topic array<string>, reference_only boolean, quality_score double")
    assert sorted(r.row_id for r in cleaning.topic_quota(df, 2).collect()) == [1, 2, 5]
    assert cleaning.topic_quota(df.limit(0), 2).count() == 0


def test_upsert_and_first_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 4)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in cleaning.upsert(old, new, "k").collect()) == [("", 3), ("a", 1), ("b", 9), ("c", 4)]
    df = spark.createDataFrame([("h", 2, "x"), ("h", 1, "y")], "h string, o int, v string")
    assert cleaning.first_wins(df, ["h"], ["o"]).first().v == "y"


def test_header(spark):
    df = spark.createDataFrame([("// Created by ann in 2014.\nx",), ("\n" * 25 + "// author: bob",), (None,), ("// All  Rights reserved",)], "code_image string")
    assert [(r.a, r.b) for r in df.select(cleaning.header_author("code_image").alias("a"), cleaning.restricted("code_image").alias("b")).collect()] == [("ann in 2014", False), ("", False), ("", False), ("", True)]


def tags(spark, code, topics=None):
    df = spark.createDataFrame([("n", None, None, code, None, topics)], "name string, description string, tags_raw array<string>, code_image string, code_common string, tags_topic array<string>")
    return df.select(analysis.rule_tags().alias("t")).first().t


def test_rule_tags(spark):
    assert tags(spark, "float sdSphere; iTime") == ["sdf", "animation"]
    assert tags(spark, "float SDSPHERE; itime") == ["uncategorized"]
    assert tags(spark, "ro + rd * t; noise", ["x"]) == ["x", "raymarching", "noise"]
    assert tags(spark, "kaleidoscope") == ["kaleidoscope", "2d-pattern"]
    assert tags(spark, None, ["uncategorized"]) == ["uncategorized"]


@pytest.mark.parametrize("counts, want", [([], 0.0), ([3, 3, 3], 0.0), ([5], 0.0), ([0, 0], 0.0), ([1, 3], 0.25)])
def test_gini(spark, counts, want):
    assert analysis.gini(spark.createDataFrame([(c,) for c in counts], "n long")).first()[0] == pytest.approx(want)


def violated(spark, code):
    return [v.rule_id for v in spark.createDataFrame([(code,)], "c string").select(rules.check("c").alias("v")).first().v]


def test_lint(spark):
    assert violated(spark, CODE) == []
    assert violated(spark, CODE.replace("in vec2", "vec2")) == []
    assert violated(spark, "") == violated(spark, " \n") == violated(spark, None) == ["GLSL000"]
    assert violated(spark, "void mainImage(int a){") == ["GLSL011", "GLSL040"]
    assert violated(spark, CODE + "\n```\nuniform float iFoo;\nuniform float iTime;\n round(1.);texture(iChannel0)") == ["GLSL020", "GLSL021", "GLSL022", "GLSL030"]
    assert violated(spark, "x while (true) {}") == ["GLSL010", "GLSL050"]


def test_convention_needs_in(spark):
    score = lambda c: spark.createDataFrame([(c,)], "c string").select(rules.convention("c")).first()[0]
    assert score(CODE) == 1.0 and score(CODE.replace("in vec2", "vec2")) == 0.8 and score("/* " + CODE + " */ uniform float a; (") == pytest.approx(0.4)


def test_errors(spark):
    df = spark.createDataFrame([("Read timed out",), ("HTTP 429",), ("missing API_KEY",), ("chroma is gone",), ("connection reset",), ("boom",), (" ",), (None,)], "e string")
    assert [(r.a, r.b) for r in df.select(rules.error_code("e").alias("a"), rules.retrieval_error_code("e").alias("b")).collect()] == [
        (50401, 50303), (42901, 42901), (50301, 50303), (50303, 50303), (50301, 50303), (50001, 50303), (None, None), (None, None)]


def test_evaluation(spark):
    col = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert col(evaluation.relevancy(arr())) == 0 and col(evaluation.relevancy(arr(1.0, 1.0))) == 1 and col(evaluation.relevancy(arr(0.1, 0.5))) == pytest.approx(0.4)
    assert [col(evaluation.fix_efficiency(F.lit(i))) for i in (0, 1, 2, 5)] == [0, 1, pytest.approx(2 / 3), 0]
    cases = spark.createDataFrame([("t", True, None, 1.0)], "task string, ok boolean, metrics array<struct<name:string,score:double,threshold:double,success:boolean,reason:string,is_llm_judge:boolean>>, elapsed_ms double")
    assert evaluation.report(cases).first().n_passed == 1, "an ok case without metrics passes"
    assert col(evaluation.fix_efficiency(F.lit(1), 0)) == 1 and col(evaluation.fix_efficiency(F.lit(2), 0)) == 0
    pairs = [spark.createDataFrame([("k", c), ("none", e), (side, "x")], "key string, code string") for side, c, e in (("a", "a\n b \n\nc\na", ""), ("b", "b\nc\nb", "z"))]
    assert {r.key: r.kept for r in evaluation.row_retention(*pairs, "key").collect()} == {"k": 0.5, "none": 0.0}


def test_lineage_ends_cycles_and_gaps(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("p", "q"), ("q", "p")], "msg_id string, parent_id string")
    got = messages.lineage(df, df.filter("msg_id in ('d', 'x', 'p')"), most=5).collect()
    by = {s: [r.msg_id for r in sorted(got, key=lambda r: r.hop) if r.start == s] for s in "dxp"}
    assert by["d"] == ["d", "c", "b", "a"] and by["x"] == ["x"] and by["p"] == ["p", "q", "p", "q", "p", "q"]


def test_nearest_against_brute_force(spark):
    import random

    rng = random.Random(3)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None), (62, [1.0] * 8), (63, [2.0] * 8)]
    df = spark.createDataFrame(vecs, "id long, embedding array<double>")
    got = search.nearest(df.filter("id % 20 = 2 or id = 62").withColumnRenamed("id", "query_id"), df, 3, block=16).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    ok = [(i, v) for i, v in vecs if v and any(v)]
    for q, v in ok:
        mine = [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        if mine:
            assert mine == [i for _, i in sorted((round(1 - cos(v, w), 9), i) for i, w in ok if i != q)[:3]]
    assert {r.query_id for r in got} == {2, 22, 42, 62}


def test_fusion_edges(spark):
    w = search.Weights()
    queries = spark.createDataFrame([(1, "glow", ["t"], ["glow"])], "query_id long, text string, want_tags array<string>, query_terms array<string>")
    parents = spark.createDataFrame([("a", ["t"], 1.0, "glow"), ("b", ["u"], 0.0, "x")], "parent_id string, tags array<string>, quality double, doc_text string")
    vec = spark.createDataFrame([(1, "a", -0.5), (1, "orphan", 0.9)], "query_id long, parent_id string, rel double")
    key = spark.createDataFrame([(1, "b", 2.0)], "query_id long, parent_id string, score double")
    got = {r.parent_id: r for r in search.fuse(vec, key, parents, queries, w).collect()}
    assert set(got) == {"a", "b"} and got["a"].vec == 0.0 and got["a"].fused == pytest.approx(0.25) and got["b"].bm25 == 1.0 and got["b"].fused == pytest.approx(0.25)
    many = spark.createDataFrame([(1, f"p{i:02d}", 1 - i / 100, ["q"], ["d"]) for i in range(31)], "query_id long, parent_id string, fused double, query_terms array<string>, doc_terms array<string>")
    out = {r.parent_id: r.fused for r in search.rerank(many, w).collect()}
    assert out["p30"] == pytest.approx(0.70) and out["p29"] == pytest.approx(0.3 * 0.71) and out["p00"] == pytest.approx(1.0)


def test_actions(spark):
    from lucerna.operators import actions

    row = spark.createDataFrame([("vec3(1.,2.,0.) vec3(.5, 0.25,1.0) vec3(0,0,0) uniform float a;", ["sdBox", "noise1"], "不要用纹理 <= 30 行", 0.5)], "c string, f array<string>, w string, q double").select(
        actions.base_colour("c").alias("rgb"), actions.fallback_techniques("c", "f").alias("t"), actions.constraints("w").alias("k"), actions.parsed("c")["uniforms"].alias("u"), actions.masked("w").alias("m"),
        actions.critique(F.lit(True), "c", F.lit("sdf"), F.lit(True)).alias("s"), actions.reference_context("f", "f", "q", "w", "c").alias("x")).first()
    assert row.rgb == [0.5, 0.25, 1.0] and row.t == ["sdf", "noise"] and row.k == ["avoid 纹理", "<= 30 lines", "no external textures"] and row.u == ["a"]
    assert row.m == "不要用纹******(len=13)" and row.s == pytest.approx(1 / 3) and row.x.startswith("[meta] tags=sdBox, noise1 | visual=sdBox, noise1 | quality=0.50\n\n[algorithm_summary]")


def test_reference_context_has_functions(spark):
    from lucerna.operators import actions

    code = "// head\n" * 300 + "float sd(vec2 p) { if (p.x > 0.) { return 1.; } return 0.; }\nvoid mainImage(out vec4 c, in vec2 f) { c = vec4(sd(f)); }"
    hit = [("overview", "overview", "about", 0.9), ("function", "sd", "Function float sd", 0.1)]
    df = spark.createDataFrame([(code, ["t"], 0.0, "", ["sd", "none"], hit)], "c string, f array<string>, q double, w string, k array<string>, m array<struct<kind:string,title:string,text:string,score:double>>")
    row = df.select(actions.reference_context("f", "f", "q", "w", "c", names="k").alias("x"), actions.reference_context("f", "f", "q", "w", "c", names="k", matched="m").alias("y")).first()
    main = "[context: mainImage]\nvoid mainImage(out vec4 c, in vec2 f) { c = vec4(sd(f)); }"
    assert row.x == "[meta] tags=t | visual=t\n\n" + main + "\n\n[context: key_function sd]\nfloat sd(vec2 p) { if (p.x > 0.) { return 1.; } return 0.; }"
    assert row.y == "[meta] tags=t | visual=t\n\n[matched_function: sd]\nFunction float sd\n\n[matched_overview: overview]\nabout\n\n" + main


def test_replies_and_prompts(spark):
    from lucerna.operators import actions

    texts = ['```json\n{"a": 1}\n```', 'so: {"a": {"b": 2}} ok', "none", None, "} {", "```glsl\n// EXPLAIN: one\n//  two \n//\nfloat x; // y\n```", "// other\nfloat x;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", actions.json_of("t").alias("j"), actions.explanation("t").alias("e"), actions.code_of("t").alias("c")).orderBy("i").collect()
    assert [r.j for r in rows[:5]] == ['{"a": 1}', '{"a": {"b": 2}}', "none", "", "} {"]
    assert rows[5].e == "one\n two" and rows[5].c == "float x; // y" and rows[6].e == "" and rows[6].c == "// other\nfloat x;"

    def plain(blocks, budget=3600):
        cut = lambda t, n: t if len(t) <= n else t[:n].rstrip() + "\n// ..."
        out, used = [], 0
        for i, b in enumerate(blocks):
            b = cut(b, 1600 if i == 1 else 1000)
            if used + len(b) > budget:
                b = cut(b, max(900, budget - used))
            if b.strip():
                out.append(b)
                used += len(b)
            if used >= budget:
                break
        return out

    cases = [[], ["a"], [" ", "b"], ["x" * 3000] * 6, ["x y " * 200, "z" * 1700, "q" * 950, "w" * 20, "v" * 990], ["k" * 999] * 5]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, b array<string>")
    assert [list(r.p) for r in df.select("i", actions.prompt_blocks(F.col("b")).alias("p")).orderBy("i").collect()] == [plain(c) for c in cases]


def test_validation_and_analysis(spark):
    from lucerna.operators import actions, rules

    good = "float sdBox(vec2 p) { return 1.; }\nfloat sdBox(float q) { return 2.; }\nvoid mainImage(out vec4 c, in vec2 f) { c = vec4(sdBox(f)); }"
    codes = [good, "void mainImage(vec4 c) { lerp(saturate(frac(x)) }", "// mainImage lerp\n", "", None, "void mainImage(out vec4 c, in vec2 f) { }"]
    rows = spark.createDataFrame([(i, c, None, None, None, None, None, [], None) for i, c in enumerate(codes)], "i int, code_image string, compile_ok boolean, render_ok boolean, likes int, reference_only boolean, has_external_assets boolean, tags_topic array<string>, key_functions array<string>")
    got = [(list(r.errors), list(r.warnings)) for r in rows.select("i", *[c.alias(n) for n, c in rules.validated("code_image").items()]).orderBy("i").collect()]
    assert got == [([], []), (["parens", "slip:lerp", "slip:saturate", "slip:frac", "signature"], []), ([], []), (["no_entry"], []), (["no_entry"], []), ([], ["no_assignment"])]
    out = actions.analyzed(rows).orderBy("i").collect()
    assert list(out[0].key_functions) == ["sdBox"] and out[4].quality_score == pytest.approx(0.1) and not out[4].compile_ok and list(out[4].key_functions) == []
    frag = actions.analyzed(rows.withColumn("code_image", F.concat(F.coalesce("code_image", F.lit("")), F.lit(" fragColor")))).orderBy("i").first()
    assert frag.compile_ok and frag.quality_score == pytest.approx(0.6)


def test_section_prompts_and_lines(spark):
    from lucerna.operators import actions

    maps = [(["globals", "f"], ["float x;", "y" * 20]), (["a", "b", "c", "d"], ["1" * 30, "2" * 9, "3" * 30, "4"])]
    df = spark.createDataFrame(maps, "k array<string>, v array<string>").select(F.map_from_arrays("k", "v").alias("s"))
    got = [r.p for r in df.select(actions.section_prompt(F.col("s"), 35, 20).alias("p")).collect()]
    assert got[0] == "\n--- section: globals ---\nfloat x;\n\n--- section: f ---\n" + "y" * 20 + "\n"
    assert got[1] == "\n--- section: a ---\n" + "1" * 20 + "\n/* cut */\n\n--- section: b ---\n222222222\n\n--- section: c ---\n/* left out */\n\n--- section: d ---\n/* left out */\n"
    log = "0(5) : error x\n0(13) : warning\nERROR: 0:40: y 10(3) 0:13: z"
    assert spark.range(1).select(actions.remapped(F.lit(log), F.lit(10), 12).alias("l")).first().l == "0(5(prologue)) : error x\n0(13(user:1)) : warning\nERROR: 0:40(epilogue): y 10(3) 0:13(user:1): z"
    assert spark.range(1).select(actions.remapped(F.lit(None), F.lit(10), 12).alias("l")).first().l == ""
