import random
import re

import numpy as np
import pytest

from lucerna.functions.code_text import without_comments
from lucerna.llm import near_copies as n


def plain(code):
    t = re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", without_comments(code))
    return set(zip(t, t[1:], t[2:]))


def test_shingles_match_plain_tokens():
    codes = ["", "a", "a b", "a b c", "float x=1.5; // c\nfloat y;", 'x "// s" é　ß 😀 a_b', "a b c a b c", "a/**/b c d", "x" * 10, "é b c", " a b c ", " a b c"]
    sets = n.shingle_sets(codes)
    for x, cx in zip(sets, codes):
        assert len(x) == len(plain(cx)), cx
        for y, cy in zip(sets, codes):
            assert len(np.intersect1d(x, y)) == len(plain(cx) & plain(cy))


def test_chunks_do_not_matter(monkeypatch):
    codes = [f"float a{i} = {i}.{i}; return a{i} + b;" for i in range(50)]
    whole = [x.tolist() for x in n.shingle_sets(codes)]
    monkeypatch.setattr(n, "CHUNK", 64)
    assert [x.tolist() for x in n.shingle_sets(codes)] == whole


def corpus(seed, size):
    rng = random.Random(seed)
    head = "void mainImage(out vec4 fragColor, in vec2 fragCoord){ vec2 uv = fragCoord / iResolution.xy;"
    lines = lambda k: [f"v{rng.randint(0, 40)} = {rng.choice(['sin', 'cos', 'abs'])}({rng.random():.3f} * v{rng.randint(0, 40)});" for _ in range(k)]
    bodies = [lines(rng.randint(8, 40)) for _ in range(size)]
    out = []
    for i, b in enumerate(bodies):
        out.append((f"s{i:04d}", "\n".join([head, *b, "}"])))
        if i % 4 == 0:
            edited = b[:]
            for _ in range(rng.randint(0, max(1, len(b) // 6))):
                edited[rng.randrange(len(edited))] = lines(1)[0]
            out.append((f"e{i:04d}", "// copy\n" + "\n".join([head, *edited, "}"])))
    return out


def test_found_against_brute_force(spark):
    rows = corpus(2, 160)
    sets = {s: plain(c) for s, c in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([*rows, rows[0], ("empty", ""), ("null", None), (None, rows[0][1]), ("tiny", "a b"), ("comment", "/* x */")], "shader_id string, code_image string").selectExpr("*", "1 as class_id", "'x' as blocks")
    got = {tuple(r) for r in n.found(df).collect()}
    assert len(want) > 30 and got == want
    members = n.membership(df).collect()
    assert len(members) == len(sets) and {m.shader_id for m in members} == set(sets)


def test_group_of_copies_is_one_class(spark):
    code = "void main(){ a = b + c; d = e * f; }"
    df = spark.createDataFrame([(f"c{i:03d}", code if i % 2 else code.replace(" ", "  ")) for i in range(40)], "shader_id string, code_image string")
    assert n.found(df).count() == 40 * 39 // 2
    rows = n.membership(df).collect()
    assert {(r.copies, r.links) for r in rows} == {(40, 0)}


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "shader_id string, code_image string")
    assert n.found(empty).count() == 0
    long = "x = y + 1.5;\n" * 200_000
    df = spark.createDataFrame([("a", long), ("b", long + "z;")], "shader_id string, code_image string")
    assert [tuple(r) for r in n.found(df).collect()] == [("a", "b")]


@pytest.mark.parametrize("a, b, want", [("a b c", "a b c", 1.0), ("a b c d", "a b c e", 1 / 3), ("", "", 0.0)])
def test_similarity(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(n.similarity("a", "b")).first()[0] == pytest.approx(want)


def test_codes_grown_from_one_base(spark):
    """A third of all codes share the base, so most of their shingles are common."""
    rng = random.Random(4)
    lines = lambda k: [f"w{rng.randint(0, 10**6)} = {rng.choice(['sin', 'cos', 'abs'])}({rng.random():.6f} * w{rng.randint(0, 10**6)});" for _ in range(k)]
    base = lines(40)
    rows = [(f"g{i:03d}", "\n".join([*base, *lines(rng.randint(2, 26))])) for i in range(60)] + [(f"o{i:03d}", "\n".join(lines(40))) for i in range(120)]
    sets = {s: plain(c) for s, c in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert len(want) > 500 and {tuple(r) for r in n.found(spark.createDataFrame(rows, "shader_id string, code_image string")).collect()} == want


@pytest.mark.parametrize("own, shared", [(82, 40), (80, 46), (70, 52)])
def test_pairs_that_share_mostly_common_lines(spark, own, shared):
    """All codes share 118 tokens; those of a pair share some of their other tokens too."""
    rng = random.Random(own)
    word = lambda: f"t{rng.randrange(10**9)}"
    common = " ".join(word() for _ in range(118))
    rows = []
    for i in range(100):
        both = [word() for _ in range(shared)]
        rows += [(f"{side}{i:03d}", " ".join([common, *both, *(word() for _ in range(own - shared))])) for side in "ab"]
    rows += [(f"x{i:03d}", " ".join([common, *(word() for _ in range(own))])) for i in range(100)]
    sets = {s: plain(c) for s, c in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in n.found(spark.createDataFrame(rows, "shader_id string, code_image string")).collect()}
    assert len(want) == 100 and got <= want and len(got) >= 99
