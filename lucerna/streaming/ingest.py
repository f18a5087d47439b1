"""Incremental ingest: new files are cleaned, merged by key and deduplicated across batches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lucerna.operators.cleaning import upsert

#: Parts of a table by hash of the key; a batch rewrites only those it touches.
PARTS = 64


def _manifests(spark: SparkSession, target: str) -> tuple[list[int], int]:
    """Numbers of the table's complete manifests, and the next free one, which a broken off write has not taken; none
    where the folder does not exist. Any other error is raised."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifests")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return [], 1
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    numbers = sorted(n for n in names if n.isdigit())
    done = [int(n) for n in numbers if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS"))]
    return done, max(map(int, numbers), default=0) + 1


def manifest(spark: SparkSession, target: str) -> tuple[int, dict[int, str]]:
    """Number for the next version, and the folder of each part of the latest complete one; (1, {}) before the first batch.

    A manifest that can't be read is an error, never an empty table.
    """
    numbers, free = _manifests(spark, target)
    if not numbers:
        return free, {}
    line = spark.read.text(f"{target}/manifests/{numbers[-1]:08d}").first()
    if line is None:
        raise ValueError(f"manifest {numbers[-1]} of {target} is empty")
    return free, {int(k): v for k, v in json.loads(line[0]).items()}


def current_version(spark: SparkSession, target: str) -> DataFrame | None:
    """The table's latest complete version; None before the first batch."""
    folders = sorted(manifest(spark, target)[1].values())
    return spark.read.parquet(*[f"{target}/{f}" for f in folders]) if folders else None


def merge_batch(spark: SparkSession, batch: DataFrame, batch_id: int, target: str, key: str, order: list[str]) -> None:
    """Write the touched parts anew with the batch's rows over the old ones, then a manifest of the next number.

    A manifest is a new file, complete or not there, so a crash leaves the last version. A batch that runs again gives
    the same table. Of equal keys within a batch the first in ``order`` (descending) stays.
    """
    newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
    newest = newest.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
    touched = [r[0] for r in newest.select("_part").distinct().collect()]
    if not touched:
        return
    number, folders = manifest(spark, target)
    old = [f"{target}/{folders[p]}" for p in touched if p in folders]
    if old:
        rows = spark.read.parquet(*old).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
        newest = upsert(rows, newest, key)
    name = f"data/b{batch_id:08d}-{uuid.uuid4().hex[:8]}"
    newest.repartition("_part").write.partitionBy("_part").parquet(f"{target}/{name}")
    folders |= {p: f"{name}/_part={p}" for p in touched}
    spark.createDataFrame([(json.dumps(folders),)], "value string").coalesce(1).write.text(f"{target}/manifests/{number:08d}")


def ingest(spark: SparkSession, source: str, schema: str, target: str, key: str, order: list[str], fmt: str = "parquet", files_per_batch: int = 100) -> StreamingQuery:
    """Read every file of ``source`` once and merge it into ``target``; ends when all present files are read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)
    work = lambda batch, batch_id: merge_batch(spark, batch, batch_id, target, key, order)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{target}/_progress").trigger(availableNow=True).start()


def distinct_stream(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """First row of each key, remembered for ``delay`` of event time: seen hashes live across batches."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows by window and ``by``; late rows count up to ``delay``."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
