"""Named tables of chunks, parents, vectors and postings: upsert by key, load, reset.

A table is a folder of versions as ``lucerna.streaming.ingest`` writes them: an upsert rewrites the parts its keys fall
in and then adds a manifest, so readers see a whole version always.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucerna.streaming.ingest import current_version, manifest, merge_batch


def upsert(rows: DataFrame, target: str, key: str, order: list[str]) -> None:
    """Put ``rows`` over those of equal ``key``; of equal keys among them the first in ``order`` (descending) stays."""
    merge_batch(rows.sparkSession, rows, manifest(rows.sparkSession, target)[0], target, key, order)


def load(spark: SparkSession, target: str) -> DataFrame:
    """The table as last written; an error where there is none."""
    table = current_version(spark, target)
    if table is None:
        raise ValueError(f"{target} holds no table")
    return table.drop("_part")


def reset(spark: SparkSession, target: str) -> None:
    """Delete the table with all its versions; nothing happens where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_postings(index: DataFrame, target: str) -> None:
    """Write the postings of a BM25 index, whole, sorted by term within files so that a reader skips what it has no term of."""
    index.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(target)


def load_postings(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
