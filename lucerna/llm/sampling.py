"""Problem 6: a sample whose cells of source and first topic have given shares.

Weights are raked by iterative proportional fitting over the two margins, records are drawn by weighted
exponential keys over all cells together, cells below what they want are lifted to it with their next smallest
keys in exchange for the largest keys of the others, and the gaps that remain are reported.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.plans.runtime import materialize

#: Keys are counted in this many buckets of a cell, so ranks are found without sorting all rows.
BUCKETS = 1 << 16
#: Parts that the range of keys is cut into at each step towards the last key drawn, and rows that may be sorted.
PARTS, FEW = 4096, 10_000
MOST_TARGETS = 100_000


def cells(records: DataFrame, topics: DataFrame) -> DataFrame:
    """(shader_id, source, topic_key): one row per shader_id, source and topic_key null where it is in no cell.

    The source is taken without letter case and outer white space; the topic is the first element of
    tags_topic if it is letter for letter a topic_name. A null in either leaves the record without a cell.
    If crawls of one shader_id disagree the greatest cell counts.
    """
    names = topics.select(F.col("topic_name").alias("first_tag"), "topic_key").filter("first_tag is not null").groupBy("first_tag").agg(F.min("topic_key").alias("topic_key"))
    source = F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rows = records.filter(F.col("shader_id").isNotNull()).select(
        "shader_id", source.alias("source"), F.when(F.size("tags_topic") > 0, F.element_at("tags_topic", 1)).alias("first_tag"))
    one = rows.groupBy("shader_id").agg(F.max(F.when(F.col("source").isNotNull() & F.col("first_tag").isNotNull(), F.struct("source", "first_tag"))).alias("c"))
    one = one.select("shader_id", F.col("c.source").alias("source"), F.col("c.first_tag").alias("first_tag"))
    return one.join(names, "first_tag", "left").select(
        "shader_id", F.when(F.col("topic_key").isNotNull(), F.col("source")).alias("source"), "topic_key")


def raked(cell_counts: dict, wanted: dict, rounds: int = 50, close: float = 1e-9) -> dict:
    """Weight of a record of each cell by iterative proportional fitting to the margins of ``wanted``.

    Cells without records get no weight; margins that no cell can serve are left out.
    """
    weight = {c: wanted[c] / n for c, n in cell_counts.items() if n and wanted.get(c, 0) > 0}
    for _ in range(rounds):
        moved = 0.0
        for axis in (0, 1):
            goal: dict = {}
            have: dict = {}
            for c, w in wanted.items():
                goal[c[axis]] = goal.get(c[axis], 0) + w
            for c, w in weight.items():
                have[c[axis]] = have.get(c[axis], 0) + w * cell_counts[c]
            for c in weight:
                factor = goal[c[axis]] / have[c[axis]]
                weight[c] *= factor
                moved = max(moved, abs(factor - 1))
        if moved < close:
            break
    return weight


def plan(population: DataFrame, targets: DataFrame) -> tuple[list[dict], int]:
    """One dict per target (target_id, source, topic_key, wanted, available, weight) and the sample size.

    The targets are a small fixed list, refused beyond MOST_TARGETS rows; the population is only counted by
    cell in Spark before anything reaches the driver. A null permille or min_rows counts as 0.
    """
    rows = targets.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    size = population.count() // 10
    keys = targets.select(F.lower("source").alias("source"), "topic_key").distinct()
    counts = {(r[0], r[1]): r[2] for r in population.groupBy("source", "topic_key").agg(F.count("*").alias("n")).join(F.broadcast(keys), ["source", "topic_key"]).collect()}
    out = []
    for r in rows:
        cell = ((r["source"] or "").lower(), r["topic_key"])
        wanted = max(math.floor((r["permille"] or 0) * size / 1000), r["min_rows"] or 0)
        out.append({"target_id": r["target_id"], "source": cell[0], "topic_key": cell[1], "wanted": wanted, "least": r["min_rows"] or 0, "available": counts.get(cell, 0)})
    wanted: dict = {}
    for t in out:
        wanted[(t["source"], t["topic_key"])] = wanted.get((t["source"], t["topic_key"]), 0) + t["wanted"]
    weights = raked(counts, {c: w for c, w in wanted.items() if w})
    for t in out:
        t["weight"] = float(weights.get((t["source"], t["topic_key"]), 0.0))
    return out, size


PLAN = "target_id int, source string, topic_key string, wanted long, least long, available long, weight double"
CELL = ["source", "topic_key"]


def last_key(rows: DataFrame, k: int) -> tuple[float, str] | None:
    """(key, shader_id) of the ``k``-th smallest row; None if there are no more than ``k``.

    The keys' range is narrowed by counts: a pass that counts PARTS parts leaves a part of it, until FEW rows can
    be sorted. Nothing but counts and the one row comes to the driver.
    """
    x, within, scale = F.col("key") / (1 + F.col("key")), F.lit(True), 1.0
    while scale < 2.0**48:
        part = F.floor(x * (scale * PARTS))
        counts = sorted((r[0], r[1]) for r in rows.filter(within).groupBy(part.alias("p")).agg(F.count("*")).collect())
        for p, n in counts:
            if k < n:
                break
            k -= n
        else:
            return None
        within, scale = part == p, scale * PARTS
        if n <= FEW:
            break
    if k:
        row = rows.filter(within).orderBy("key", "shader_id").offset(k - 1).limit(1).first()
        return row["key"], row["shader_id"]
    row = rows.filter(x * scale < p).agg(F.max(F.struct("key", "shader_id")).alias("m")).select("m.*").first()
    return (row[0], row[1]) if row[0] is not None else (-1.0, "")


def lowest(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``kept``: whether a row is among the ``wanted`` smallest keys of its cell.

    A cell's keys are counted by bucket; only the rows of the bucket in which the rank falls are sorted.
    """
    counted = keyed.filter("wanted > 0").groupBy(*CELL, "wanted", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*CELL).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counted.withColumn("before", before).filter("before < wanted and wanted <= before + n").select(*CELL, F.col("bucket").alias("edge"), "before")
    placed = materialize(keyed.join(F.broadcast(edge), CELL, "left"))
    at = placed.filter("bucket = edge").withColumn("r", F.row_number().over(Window.partitionBy(*CELL).orderBy("key", "shader_id")))
    rest = placed.filter("edge is null or bucket <> edge").withColumn("kept", F.expr("wanted > 0 and (edge is null or bucket < edge)"))
    return at.withColumn("kept", F.expr("before + r <= wanted")).drop("r").unionByName(rest).select("shader_id", *CELL, "key", "kept")


def draw(records: DataFrame, topics: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(shader_id, source, topic_key) of the sample, and the report.

    A record's key is -ln(u) / weight with u from a hash of its id and ``seed``; a draw of the sample size takes
    the smallest keys of all cells together. The repair lifts every cell below what it wants with its next
    smallest keys, and takes as many of the largest keys from cells above it. So the sample is the ``wanted``
    smallest keys of each cell and, up to the sample size, the smallest keys of all other records: which cells
    these are, where others have too few records, is up to the raked weights. If the wants add up to more than
    the sample size the sample is larger. Records in no wanted cell are never drawn.
    Report: (target_id, source, topic_key, wanted, available, expected, drawn, gap): expected rows by the raked
    weights, drawn rows of the cell, and gap = what the target still lacks.
    """
    spark = records.sparkSession
    population = materialize(cells(records, topics))
    goals, size = plan(population, targets)
    table = spark.createDataFrame([tuple(t[c.split()[0]] for c in PLAN.split(", ")) for t in goals], PLAN)
    wants: dict = {}
    for t in goals:
        cell = (t["source"], t["topic_key"])
        wants[cell] = (wants.get(cell, (0,))[0] + t["wanted"], t["weight"], t["available"])
    by_cell = spark.createDataFrame([(*c, w[0], w[1]) for c, w in wants.items()], "source string, topic_key string, wanted long, weight double")
    u = (F.pmod(F.xxhash64("shader_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = (
        population.filter("topic_key is not null").join(F.broadcast(by_cell), CELL).filter("weight > 0")
        .select("shader_id", *CELL, "wanted", (-F.log(u) / F.col("weight")).alias("key"), F.floor(BUCKETS * (1 - u)).cast("int").alias("bucket"))
    )
    marked = materialize(lowest(keyed))
    others, room = marked.filter("not kept"), size - sum(min(w[0], w[2]) for w in wants.values())
    last = last_key(others, room) if room > 0 else (-1.0, "")
    if last:
        others = others.filter((F.col("key") < last[0]) | ((F.col("key") == last[0]) & (F.col("shader_id") <= last[1])))
    sample = materialize(marked.filter("kept").unionByName(others).select("shader_id", *CELL))
    drawn = sample.groupBy(*CELL).agg(F.count("*").alias("drawn"))
    report = table.join(F.broadcast(drawn), CELL, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return sample, report.select(
        "target_id", *CELL, "wanted", "available", F.round(F.col("weight") * F.col("available"), 6).alias("expected"), "drawn", F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0)).alias("gap"))


def found(records: DataFrame, topics: DataFrame, targets: DataFrame) -> DataFrame:
    """p6_found: (target_id) of the targets that the drawn and repaired sample does not reach."""
    return draw(records, topics, targets)[1].filter("gap > 0").select("target_id")
