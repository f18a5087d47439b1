"""Working memory: messages by session, their latest and their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.plans.runtime import materialize


def latest(messages: DataFrame, session: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` messages of each session; none for n <= 0."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def having(messages: DataFrame, column: str, value) -> DataFrame:
    """The messages of a role, of a payload type or with an id: a filter that reaches the scan."""
    return messages.filter(F.col(column) == value)


def lineage(messages: DataFrame, starts: DataFrame, key: str = "msg_id", parent: str = "parent_id", most: int = 1024) -> DataFrame:
    """(start, hop, msg_id): every start message with its ancestors, at most ``most`` hops, so cycles end.

    Pointer doubling: after k rounds a message knows 2^k ancestors, so a chain of n hops takes log2(n) joins.
    Ids that are missing end a chain.
    """
    links = messages.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("up")).distinct()
    known = links.select(F.col("id").alias("k"))
    step = materialize(links.join(known, F.col("up") == F.col("k"), "left_semi").select("id", "up"))
    found = starts.select(F.col(key).alias("start")).join(known, F.col("start") == F.col("k"), "left_semi").distinct().select("start", F.lit(0).alias("hop"), F.col("start").alias("id"))
    jump, reach = step, 1
    while reach <= most:
        more = found.join(jump, "id").select("start", (F.col("hop") + reach).alias("hop"), F.col("up").alias("id")).filter(F.col("hop") <= most)
        if more.isEmpty():
            break
        found = materialize(found.unionByName(more))
        jump = materialize(jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.id")).select("a.id", "b.up"))
        reach *= 2
    return found.select("start", "hop", F.col("id").alias("msg_id"))


def running_budget(parts: DataFrame, group: str, order: list[str], length: str, budget: int) -> DataFrame:
    """The leading parts of each group whose lengths together stay within ``budget``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("used", F.sum(length).over(w)).filter(F.col("used") <= budget)
