import pytest
from pyspark.sql import functions as F

from lucerna.functions.current import current_rows
from lucerna.plans import runtime


def test_materialize_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, ["a", None], None), (2, None, b"x")], "i long, l array<string>, b binary")
    out = runtime.materialize(df)
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert runtime.materialize(df.limit(0)).count() == 0


def test_salted_join_equals_a_join(spark):
    left = spark.range(200).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 10)).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, w int")
    for how, hot in (("inner", 4), ("left", 4), ("inner", 1000), ("left", 25)):
        want = sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=str)
        got = sorted(map(tuple, runtime.salted_join(left, right, "k", "v", how, hot).select("k", "v", "w").collect()), key=str)
        assert got == want


def test_current_rows(spark):
    df = spark.createDataFrame([("a", 1, 5, "old"), ("a", 2, 5, "new"), ("a", 9, 4, "older"), ("b", 1, None, "only"), (None, 1, 1, "no key")], "shader_id string, row_id long, at int, v string").withColumn("ingested_at", F.timestamp_seconds("at"))
    assert sorted(map(tuple, current_rows(df, "v").collect())) == [("a", "new"), ("b", "only")]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Dir:
        @staticmethod
        def isDefined():  # noqa: N802
            return False

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class Sc:
                        @staticmethod
                        def getCheckpointDir():  # noqa: N802
                            return Dir

                    return Sc

    with pytest.raises(ValueError):
        runtime.shared_dir(Session)


def test_release_deletes_the_tables(spark, tmp_path):
    import os

    runtime.materialize(spark.range(3))
    folder = runtime.scratch(spark).removeprefix("file:")
    assert os.listdir(folder)
    runtime.release(spark)
    assert not os.path.exists(folder)
    assert runtime.materialize(spark.range(3)).count() == 3
