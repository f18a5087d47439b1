"""Problem 2: keep at most so many records, or such a share of all, of one contributor, the best by quality."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.functions.current import current_rows
from lucerna.plans.runtime import materialize

#: Buckets of scores between 0 and 1.
BUCKETS = 4096


@F.pandas_udf(T.StringType())
def contributor(names: pd.Series) -> pd.Series:
    """NFKC, case folding, white space trimmed; null where nothing is left."""
    return names.map(lambda s: (unicodedata.normalize("NFKC", s).casefold().strip() or None) if isinstance(s, str) else None)


def ranked(records: DataFrame, limit: int = 10, share: float | None = None, salts: int = 32) -> DataFrame:
    """(shader_id, contributor, kept) of the current rows that have a contributor.

    ``limit``: most records of a contributor; ``share``: most as a share of all records that have a contributor, one
    at least. The smaller of the two holds. Scores are first counted by contributor and bucket, so that only the
    bucket in which a contributor's limit falls is ranked, whatever the limit: within (contributor, salt) first, and
    what is within the room left of each salt meets for the final rank. Null and NaN scores come last, ties go to the
    smaller shader_id. Null or blank usernames give no row.
    """
    rows = (
        current_rows(records, "username", "quality_score")
        .withColumn("contributor", contributor("username"))
        .filter(F.col("contributor").isNotNull())
        .withColumn("score", F.when(~F.isnan("quality_score"), F.col("quality_score")))
        .withColumn("bucket", F.when(F.col("score").isNull(), F.lit(-(1 << 62))).otherwise(F.floor(F.greatest(F.least("score", F.lit(1e9)), F.lit(-1e9)) * BUCKETS)))
        .select("shader_id", "contributor", "score", "bucket")
    )
    if share is not None:
        rows = materialize(rows)
        limit = min(limit, max(1, int(share * rows.count())))
    counted = rows.groupBy("contributor", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("contributor").orderBy(F.desc("bucket"))) - F.col("n")
    room = counted.select("contributor", "bucket", "n", (F.lit(limit) - before).alias("room"))
    placed = rows.join(room, ["contributor", "bucket"])
    settled = placed.filter("room <= 0 or n <= room").select("shader_id", "contributor", (F.col("room") > 0).alias("kept"))
    order = [F.col("score").desc_nulls_last(), F.col("shader_id").asc()]
    edge = placed.filter("room > 0 and n > room").withColumn("salt", F.pmod(F.xxhash64("shader_id"), F.lit(salts)).cast("int"))
    pre = edge.withColumn("r1", F.row_number().over(Window.partitionBy("contributor", "salt").orderBy(*order)))
    meet = pre.filter("r1 <= room").withColumn("r2", F.row_number().over(Window.partitionBy("contributor").orderBy(*order)))
    return (
        settled.unionByName(meet.select("shader_id", "contributor", (F.col("r2") <= F.col("room")).alias("kept")))
        .unionByName(pre.filter("r1 > room").select("shader_id", "contributor", F.lit(False).alias("kept")))
    )


def found(records: DataFrame, limit: int = 10, share: float | None = None) -> DataFrame:
    """p2_found: (shader_id) of the records beyond the limit."""
    return ranked(records, limit, share).filter(~F.col("kept")).select("shader_id")


def shares(records: DataFrame, limit: int = 10, share: float | None = None) -> DataFrame:
    """(contributor, records, kept, dropped, share): how much each contributor loses by the limit."""
    by = ranked(records, limit, share).groupBy("contributor").agg(
        F.count("*").alias("records"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
    total = by.agg(F.sum("records").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("contributor", "records", "kept", "dropped", (F.col("records") / F.col("total")).alias("share"))
