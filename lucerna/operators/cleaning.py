"""Cleaning, first-wins deduplication, upserts and quotas of the record corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.text import code_hash, head_lines, text
from lucerna.plans.runtime import materialize

#: Inputs that need assets from outside, and sources exempt from likes and length.
EXTERNAL = ("texture", "cubemap", "volume", "video", "webcam", "music", "musicstream", "mic", "keyboard", "buffer")
TRUSTED = ("seed", "local", "shaders21k", "isf")
RESTRICTED = r"(?i)all[ \t\n\r]*rights[ \t\n\r]*reserved|proprietary|do[ \t\n\r]*not[ \t\n\r]*redistribute|no[ \t\n\r]*permission|confidential"


def _last_code(kind: str) -> Column:
    own = F.filter("passes", lambda p: F.lower(p["type"]) == kind)
    return F.when(F.size(own) > 0, F.coalesce(F.element_at(own, -1)["code"], F.lit(""))).otherwise("")


def with_code(records: DataFrame) -> DataFrame:
    """Adds image, common, external, code: from the passes if the first has code, else from the record.

    The last pass of a kind wins. ``code`` is what length and hash use: the record's own code where it has some.
    """
    by_pass = F.coalesce(F.get("passes", F.lit(0))["code"], F.lit("")) != ""
    outside = F.exists("passes", lambda p: F.exists(F.coalesce(p["inputs"], F.array().cast("array<map<string,string>>")), lambda i: F.lower(i["ctype"]).isin(*EXTERNAL)))
    image = F.when(by_pass, _last_code("image")).otherwise(text("code_image"))
    common = F.when(by_pass, _last_code("common")).otherwise(text("code_common"))
    return (
        records.withColumn("image", image).withColumn("common", common)
        .withColumn("external", F.coalesce(F.when(by_pass, outside).otherwise(F.col("has_external_assets")), F.lit(False)))
        .withColumn("code", F.coalesce(F.nullif(text("code_image"), F.lit("")), F.col("image")))
    )


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``. Partial aggregation keeps one row per key and task before the
    shuffle, so a key that holds a third of all rows does not meet in one task."""
    whole = F.struct(*df.columns)
    return df.groupBy(*key).agg(F.min_by(whole, F.struct(*order)).alias("_first")).select("_first.*")


def marks(records: DataFrame, order: str = "row_id", min_likes: int = 30, min_chars: int = 200, max_chars: int = 12000) -> DataFrame:
    """(order, new_hash, drop_reason): no_image, external, likes, length, duplicate, or null for kept rows.

    Duplicates are ranked only among rows that survive the earlier filters; the first in ``order``, which is unique,
    stays. Null likes count as 0, a null source is not trusted. The code is read once; only these columns go on.
    """
    trusted = F.coalesce(F.col("source").isin(*TRUSTED), F.lit(False))
    reason = (
        F.when(F.col("image") == "", "no_image")
        .when(F.col("external") & (text("source") != "seed"), "external")
        .when((F.coalesce("likes", F.lit(0)) < min_likes) & ~trusted, "likes")
        .when(~F.length("code").between(min_chars, max_chars) & ~trusted, "length")
    )
    rows = with_code(records).withColumn("reason", reason)
    rows = materialize(rows.select(order, "reason", F.when(F.col("reason").isNull(), code_hash("code", F.coalesce(F.nullif(text("code_common"), F.lit("")), F.col("common")))).alias("new_hash")))
    kept = rows.filter("reason is null").groupBy("new_hash").agg(F.min(order).alias("_kept")).select("_kept")
    return rows.join(kept, F.col(order) == F.col("_kept"), "left").select(
        order, "new_hash", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_kept").isNull(), "duplicate").alias("drop_reason"))


def clean(records: DataFrame, order: str = "row_id", **bounds) -> DataFrame:
    """The records with the columns of ``with_code``, new_hash and drop_reason of ``marks``."""
    return with_code(records).join(marks(records, order, **bounds), order)


def drop_reasons(records: DataFrame) -> DataFrame:
    return marks(records).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


def restricted(code) -> Column:
    """A restrictive phrase in the first 30 lines."""
    return head_lines(code, 30).rlike(RESTRICTED)


def header_author(code) -> Column:
    """The author named by a comment of the first 20 lines, without a final period; '' if none."""
    named = F.regexp_extract(head_lines(code, 20), r"(?i)//[ \t]*(?:Created[ \t]+by|Author:?[ \t]*|@author[ \t]+)([^\n]+)", 1)
    return F.regexp_replace(F.trim(named), r"\.+$", "")


def topic_quota(records: DataFrame, per_topic: int, order: str = "row_id", salts: int = 16) -> DataFrame:
    """At most ``per_topic`` records of each primary topic, reference-only ones first, then by quality.

    The primary topic is the first, the second where the first is 'uncategorized' and there are more. Ranks
    within a salt first, so a hot topic's final rank sees at most ``per_topic * salts`` rows.
    """
    tags = F.col("tags_topic")
    primary = F.when(F.coalesce(F.size(tags), F.lit(0)) < 1, F.lit("uncategorized")).when((F.size(tags) > 1) & (tags[0] == "uncategorized"), tags[1]).otherwise(tags[0])
    rows = records.withColumn("primary_topic", F.coalesce(primary, F.lit("uncategorized"))).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    by = [F.coalesce("reference_only", F.lit(False)).desc(), F.when(~F.isnan("quality_score"), F.col("quality_score")).desc_nulls_last(), F.col(order)]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("primary_topic", "_salt").orderBy(*by))).filter(F.col("_r") <= per_topic)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("primary_topic").orderBy(*by))).filter(F.col("_r") <= per_topic).drop("_r", "_salt")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new``, unique on ``key``, and those of ``old`` whose key it lacks. Null keys of old stay."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
