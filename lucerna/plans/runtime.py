"""Plan helpers shared by the operators: cutting lineage, spreading Python work, joining on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key beyond which ``salted_join`` deals them to several tasks.
HOT = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session may fall back to a temporary folder; on a cluster an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession) -> str:
    """The session's own folder within the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/lucerna-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the table.

    Cuts the lineage like a checkpoint, survives the loss of an executor, and stays columnar, so later
    readers scan only the columns they need. ``release`` deletes the session's tables.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables of ``materialize``: to be called once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession) -> int:
    """Tasks for CPU-heavy stages: the configured shuffle width, at least two per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition for a CPU-heavy stage when the scan gives fewer than two tasks for each core."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(task_count(spark), *keys)


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_of: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """Join a large ``left`` with hot keys to a ``right`` that is unique on ``key``; ``left`` is read twice.

    Keys of more than ``hot`` rows are found by a count first. Their rows get a salt from ``salt_of``, as many as there
    are parts of that size, and only their rows of ``right`` are repeated. Column names other than ``key`` must differ.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot)
    parts = materialize(counts.select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / hot).cast("int").alias("_parts")))
    if parts.isEmpty():
        return left.join(right, key, how)
    left = left.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_hot", "_parts")
    right = right.join(parts, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
