import random

import pytest

from lucerna.llm import canonical as c

ENTRIES = [("t1", "ray marching"), ("t1", "rm"), ("t2", "distance field"), ("t3", "soft shadows"), ("t4", "hot air"), ("t5", "moire"), ("t6", "julia set"), ("t6", "julia")]
TRIE = c.Trie(ENTRIES)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_levenshtein():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    trie = c.Trie([(w, w) for w in words])
    for _ in range(200):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        for k in (0, 1, 2, 3):
            assert trie.within(q, k) == {w: distance(q, w) for w in words if distance(q, w) <= k}


@pytest.mark.parametrize("value, want", [
    ("#RayMarching", "t1"), ("ray​marching", "t1"), ("r\xe1y m\xe0rching", "t1"), ("rаy marching", "t1"), ("marching, ray", "t1"), ("the ray marching effect", "t1"), ("2d ray marching", "t1"), ("RM", "t1"),
    ("rx", ""), ("distance fie.", "t2"), ("s0ft shad0ws", "t3"), ("sftshadows", "t3"), ("airport", ""), ("moié", "t5"), ("museum!", ""), ("\U0001f600", ""), ("julia sett", "t6"), ("x" * 100_000, ""), ("ｊｕｌｉａ　ｓｅｔ", "t6")])
def test_meant(value, want):
    assert c.meant(value, TRIE) == want


def test_found(spark):
    fields = "shader_id string, categories array<string>, tags_raw array<string>, tags_topic array<string>, raw_value string, topic_key int, _salt string"
    rows = [("a", ["moire", "Moire", None, " ", "　"], ["museum"], None, "x", 1, "y"), ("a", None, None, ["Moire"], None, None, None), (None, ["Moire"], None, None, None, None, None), ("b", [], [], [], None, None, None)]
    topics = spark.createDataFrame([("t5", "moire", ["interference"]), ("t9", None, None), (None, "x", ["y"])], "topic_key string, topic_name string, aliases array<string>")
    df = spark.createDataFrame(rows, fields)
    got = sorted(map(tuple, c.found(df, topics).collect()))
    assert got == [("a", "Moire", "t5"), ("a", "museum", "")]
    assert c.found(df.limit(0), topics).count() == 0
    assert {r.topic_key for r in c.found(df, topics.limit(0)).collect()} == {""}
    assert [tuple(r) for r in c.unmatched_report(df, topics).collect()] == [("museum", 1)]
