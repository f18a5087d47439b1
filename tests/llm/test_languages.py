import pytest

from lucerna.llm import languages as la

EN = "The wave keeps the floor from breaking up when the camera gets close."
DE = "Ohne diese Zeile würde der Schatten nach kurzer Zeit flackern."
FR = "Cette valeur règle la force avec laquelle la lueur recouvre le sol."
ZH = "如果在小屏幕上图案太硬，请把这个数调小。"
JA = "この値で影が背景をどれだけ覆うかが決まります。"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("en", EN), ("EN ", EN + " It is cheaper to blend the fog here than to compute the seam again."), ("de", DE + " Hier wird das Muster noch einmal gefaltet."), ("fr", FR), (None, DE), ("xx", DE), ("de", None), ("", "x"), ("fr", DE)]
    return spark.createDataFrame(rows * 3, "lang string, text string")


@pytest.mark.parametrize("text, want", [
    (EN, True), (ZH, True), (JA, True), ("float ray = abs(uv.x-0.295);", False), ("Created by some one else in 2016", False), ("https://notes.example/a/b", False), ("film grain", False), ("@author some body of ours", False),
    ("Licensed under the MIT license by all of us", False), ("", False), ("----------", False)])
def test_is_sentence(text, want):
    assert la.is_sentence(text) is want


def test_passages():
    first, _, rest = DE.partition(" der ")
    code = f'/*\n * {first}\n * der {rest}\n */\n/// @brief {EN}\n// {FR[:20]}\\\n {FR[20:]}\nprint("{ZH}");\n/*{{"DESCRIPTION": "{EN}", "N": [1]}}*/'
    got = [s for p in la.passages(code) for s in la.sentences(p)]
    assert DE in got and got.count(EN) == 2 and ZH in got and len(got) == 5, got


def test_found(spark, documents):
    pad = "float x = 1.0;\n" * 40
    rows = [(1, "a", f"// {EN}\n// {DE}\nfloat x;"), (1, "a", f"// {EN}\n// {DE}\nfloat x;"), (2, "b", f'"{FR}" // {JA}'), (3, "c", None), (4, "d", ""), (5, "e", pad), (6, None, f"// {EN}"), (7, "f", f"// {ZH}\n" + pad * 20)]
    df = spark.createDataFrame(rows, "row_id long, shader_id string, code_image string").selectExpr("*", "'x' as lang", "1 as hash", "2 as chars")
    got = {tuple(r) for r in la.found(df, documents).collect()}
    assert got == {("a", "en"), ("a", "de"), ("b", "fr"), ("b", "ja")}
    share = {(r.shader_id, r.lang): r for r in la.shares(df, documents).collect()}
    assert share[("a", "en")].chars == len(EN) and share[("a", "en")].n_chars == len(rows[0][2]) and 0 < share[("f", "zh")].share < 0.05
    assert la.found(df.limit(0), documents).count() == 0
    assert {r.lang for r in la.found(df, documents.limit(0)).collect()} <= {"zh", "ja"}, "without a model only scripts tell"


def test_held_out(spark, data):
    docs = spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet")
    model = la.train(docs)
    frames = {EN: "en", DE: "de", FR: "fr", "Este valor decide cuánto cubre el brillo a la segunda capa.": "es", "Ainda não sei por que a borda não fica certo nas laterais.": "pt", "Questo valore decide quanto il disegno copre la luce.": "it",
              "Nadal nie wiem, czemu światło nie zgadza się przy krawędzi.": "pl", "Без этой строки волна через минуту начинает мерцать.": "ru", ZH: "zh", JA: "ja", "Ohne diese Zeile wuerde das Leuchten flackern.": "de"}
    assert {t: la.classify(t, model) for t in frames} == frames


def test_words_that_are_licenses_or_code_elsewhere():
    from lucerna.llm.languages import is_sentence

    for s in ("Der Rand wird mit dem Rauschen gemischt.", "In terms of cost the loop is the slow part.", "We fold the wave first; it is cheaper than to blend it.", "The method is told at https://example.org/a_b and used here.", "The value of smoothstep(a, b, x) is kept for the edge here."):
        assert is_sentence(s), s
    for s in ("This shader is under MIT as all others here.", "float d = length(p); d += 1.0;", "return mix(a, b, t);", "https://example.org/some/long/path", "Permission is hereby granted to use this file.", "uv.x uv.y col.rgb base_color some_name"):
        assert not is_sentence(s), s
