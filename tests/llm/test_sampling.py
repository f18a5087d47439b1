from lucerna.llm import sampling

R = "shader_id string, source string, tags_topic array<string>, bucket int, key string, wanted int"


def tables(spark, records, targets):
    topics = spark.createDataFrame([("t1", "one"), ("t2", "two"), ("t0", None)], "topic_key string, topic_name string")
    return spark.createDataFrame([(*r, 1, "k", 2) for r in records], R), topics, spark.createDataFrame(targets, "target_id int, source string, topic_key string, permille int, min_rows int")


def test_cells(spark):
    rows = [("a", " ISF ", ["one", "two"]), ("b", None, ["one"]), ("c", "isf", []), ("d", "isf", None), ("e", "isf", [None, "one"]), ("f", "isf", ["One"]), (None, "isf", ["one"]), ("b", "isf", ["one"])]
    df, topics, _ = tables(spark, rows, [(1, "isf", "t1", 1000, 0)])
    got = {r.shader_id: (r.source, r.topic_key) for r in sampling.cells(df, topics).collect()}
    assert got == {"a": ("isf", "t1"), "b": ("isf", "t1"), "c": (None, None), "d": (None, None), "e": (None, None), "f": (None, None)}


def test_sample_reaches_targets_or_reports(spark):
    rows = [(f"x{i:04d}", "isf", ["one"]) for i in range(600)] + [(f"y{i:04d}", "seed", ["two"]) for i in range(397)] + [(f"z{i}", "local", ["one"]) for i in range(3)]
    df, topics, targets = tables(spark, rows, [(1, "isf", "t1", 600, 0), (2, "Seed", "t2", 390, 1), (3, "local", "t1", 10, 5), (4, "local", "t2", 0, 2), (5, None, "t2", None, None)])
    sample, report = sampling.draw(df, topics, targets)
    got = {r.target_id: (r.wanted, r.available, r.drawn, r.gap) for r in report.collect()}
    assert got == {1: (60, 600, 60, 0), 2: (39, 397, 39, 0), 3: (5, 3, 3, 2), 4: (2, 0, 0, 2), 5: (0, 0, 0, 0)}
    ids = [r.shader_id for r in sample.collect()]
    assert len(ids) == len(set(ids)) == 102 and set(ids) != {r[0] for r in rows[:60] + rows[600:639] + rows[-3:]}
    assert sorted(r.target_id for r in sampling.found(df, topics, targets).collect()) == [3, 4]
    again = sampling.draw(df, topics, targets)[0]
    assert sorted(ids) == sorted(r.shader_id for r in again.collect()), "the same seed draws the same rows"


def test_raking_keeps_margins():
    counts = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100, ("b", "y"): 0}
    wanted = {("a", "x"): 20, ("a", "y"): 20, ("b", "x"): 10, ("b", "y"): 5}
    w = sampling.raked(counts, wanted)
    assert set(w) == {("a", "x"), ("a", "y"), ("b", "x")} and all(v > 0 for v in w.values())
    x = w[("a", "x")] * 10 + w[("b", "x")] * 100
    assert abs(x - 30) < 1.0


def test_empty(spark):
    df, topics, targets = tables(spark, [], [(1, "isf", "t1", 1000, 1)])
    assert [r.target_id for r in sampling.found(df, topics, targets).collect()] == [1]
    assert sampling.found(df, topics, targets.limit(0)).count() == 0


def test_raked_weights_decide_who_fills_in(spark, monkeypatch):
    """Cell (a, x) is short by 40 rows; its margins' other cells get them, not (c, z)."""
    rows = [(f"p{i:03d}", "a", ["one"]) for i in range(10)] + [(f"q{i:03d}", "a", ["two"]) for i in range(300)] + [(f"r{i:03d}", "b", ["one"]) for i in range(300)] + [(f"s{i:03d}", "c", ["three"]) for i in range(390)]
    df, _, targets = tables(spark, rows, [(1, "a", "t1", 500, 0), (2, "a", "t2", 100, 0), (3, "b", "t1", 100, 0), (4, "c", "t3", 300, 0)])
    topics = spark.createDataFrame([("t1", "one"), ("t2", "two"), ("t3", "three")], "topic_key string, topic_name string")
    sample, report = sampling.draw(df, topics, targets)
    by = {r.target_id: (r.wanted, r.drawn, r.gap) for r in report.collect()}
    assert by[1] == (50, 10, 40) and sum(d for _, d, _ in by.values()) == 100 and by[2][1] + by[3][1] > 40 and by[4][1] < 50
    ids = {r.shader_id for r in sample.collect()}
    monkeypatch.setattr(sampling, "raked", lambda counts, wanted: dict.fromkeys(wanted, 1.0))
    assert {r.shader_id for r in sampling.draw(df, topics, targets)[0].collect()} != ids


def test_last_key(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id % 400 * 0.37 as key", "cast(id as string) as shader_id")
    want = sorted((r.key, r.shader_id) for r in df.collect())
    for few in (10_000, 5):
        monkeypatch.setattr(sampling, "FEW", few)
        assert [sampling.last_key(df, k) for k in (1, 2, 400, 999)] == [want[k - 1] for k in (1, 2, 400, 999)] and sampling.last_key(df, 1000) is None
