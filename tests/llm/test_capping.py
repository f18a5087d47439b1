import datetime
import random

import pytest
from pyspark.sql import functions as F

from lucerna.llm import capping

FIELDS = "row_id long, shader_id string, username string, quality_score double, ingested_at timestamp, contributor int, score string, r1 int"
T = datetime.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "", 0) for r in rows], FIELDS)


def test_order_ties_and_names(spark):
    rows = [(i, f"s{i:02d}", ["Ann ", "ＡＮＮ", "ann　"][i % 3], 0.5, T) for i in range(12)] + [(20, "s90", "ann", None, T), (21, "s91", "ann", float("nan"), T), (22, "s92", "ann", 0.9, T)]
    rows += [(30, "n1", None, 0.1, T), (31, "n2", " \t", 0.1, T), (32, None, "ann", 1.0, T)]
    got = sorted(r.shader_id for r in capping.found(frame(spark, rows)).collect())
    assert got == ["s09", "s10", "s11", "s90", "s91"]


def test_current_row_counts(spark):
    late = T + datetime.timedelta(1)
    rows = [(1, "a", "x", 0.9, T), (2, "a", "y", 0.1, late), (3, "b", "y", 0.5, T), (3, "b", "y", 0.5, T), (4, "b", "z", 0.5, T), (5, "c", "y", 0.4, None)]
    got = {(r.shader_id, r.contributor, r.kept) for r in capping.ranked(frame(spark, rows), 1).collect()}
    assert got == {("a", "y", False), ("b", "z", True), ("c", "y", True)}


def test_hot_contributor_against_brute_force(spark):
    rows = [(i, f"id{i * 7919 % 4001:04d}", "hot" if i % 3 else f"u{i % 50}", (i * 31 % 97) / 97, T) for i in range(3000)]
    by = {}
    for _, s, u, q, _ in rows:
        by.setdefault(u, []).append((-q, s))
    want = sorted(s for v in by.values() for _, s in sorted(v)[10:])
    assert sorted(r.shader_id for r in capping.found(frame(spark, rows)).collect()) == want
    shares = {r.contributor: r for r in capping.shares(frame(spark, rows)).collect()}
    assert shares["hot"].kept == 10 and abs(shares["hot"].share - len(by["hot"]) / 3000) < 1e-9
    assert capping.found(frame(spark, rows[:0])).count() == 0


@pytest.mark.parametrize("limit, share", [(3, None), (10**9, 0.2), (1, 0.9), (7, 0.05), (10**9, 1.0)])
def test_limits_and_shares_against_brute_force(spark, limit, share):
    rng = random.Random(8)
    rows = [(f"s{i:04d}", i, rng.choice(["a", "a", "A ", "b", "c"]), rng.choice([None, float("nan"), 0.5, 0.5001, 0.50011, rng.random(), -3.0, 1e12])) for i in range(400)]
    df = spark.createDataFrame(rows, "shader_id string, row_id long, username string, quality_score double").withColumn("ingested_at", F.timestamp_seconds("row_id")).withColumn("bucket", F.lit(1)).withColumn("room", F.lit("x"))
    most = limit if share is None else min(limit, max(1, int(share * len(rows))))
    want = set()
    for who in "abc":
        own = sorted((r for r in rows if r[2].strip().lower() == who), key=lambda r: (r[3] is None or r[3] != r[3], -(r[3] if r[3] is not None and r[3] == r[3] else 0), r[0]))
        want |= {r[0] for r in own[most:]}
    got = [r.shader_id for r in capping.found(df, limit, share).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert capping.ranked(df, limit, share).count() == len(rows)
