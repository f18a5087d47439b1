"""Evaluation analytics over cases with their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _metrics() -> Column:
    return F.filter(F.coalesce(F.col("metrics"), F.array().cast("array<struct<name:string,score:double,threshold:double,success:boolean,reason:string,is_llm_judge:boolean>>")), lambda m: m.isNotNull())


def case_scores(cases: DataFrame) -> DataFrame:
    """Adds mean_score (0 without metrics, a null score counts as 0) and passed (true for an ok case without metrics)."""
    scores = F.transform(_metrics(), lambda m: F.coalesce(m["score"], F.lit(0.0)))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return cases.withColumn("mean_score", F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(0.0)).withColumn(
        "passed", F.coalesce("ok", F.lit(False)) & F.forall(_metrics(), lambda m: F.coalesce(m["success"], F.lit(False))))


def report(cases: DataFrame) -> DataFrame:
    """One row by task: cases, passed, pass rate, mean of case means, mean latency."""
    return case_scores(cases).groupBy(F.coalesce("task", F.lit("")).alias("task")).agg(
        F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"),
        F.round(F.avg("mean_score"), 6).alias("mean_score"), F.round(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)), 4).alias("avg_latency_ms"))


def by_metric(cases: DataFrame) -> DataFrame:
    """(name, mean, low, high, n) of every metric; null scores are left out."""
    rows = cases.select(F.explode(_metrics()).alias("m")).select("m.name", "m.score").filter("name is not null and score is not null and not isnan(score)")
    return rows.groupBy("name").agg(F.round(F.avg("score"), 4).alias("mean"), F.round(F.min("score"), 4).alias("low"), F.round(F.max("score"), 4).alias("high"), F.count("*").alias("n"))


def relevancy(scores: Column, least: float = 0.15) -> Column:
    """Half the share of scores from ``least`` on, half their mean up to 1; 0 without scores."""
    n = F.size(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, 0.5 * F.size(F.filter(scores, lambda s: s >= least)) / n + 0.5 * F.least(F.lit(1.0), total / n)).otherwise(0.0)


def fix_efficiency(rounds: Column, most: int = 3) -> Column:
    """1 for one round, less by 1/most for each further one, 0 beyond and for no round; only one round counts if none
    more is allowed."""
    rounds = F.coalesce(rounds, F.lit(0))
    if most <= 0:
        return F.when(rounds == 1, 1.0).otherwise(0.0)
    return F.when(rounds <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (rounds - 1) / F.lit(float(most))))


def gate(cases: DataFrame, most_failed: float = 0.02, slowest: float = 5000.0) -> DataFrame:
    """One row by task: failure ratio, 95th percentile of the latency, and whether both are within bounds."""
    agg = cases.groupBy(F.coalesce("task", F.lit("")).alias("task")).agg(
        F.avg((~F.coalesce("ok", F.lit(False))).cast("int")).alias("fail_ratio"), F.coalesce(F.percentile("elapsed_ms", F.lit(0.95)), F.lit(0.0)).alias("p95"))
    return agg.select("task", F.round("fail_ratio", 6).alias("fail_ratio"), F.round("p95", 4).alias("p95"), ((F.col("fail_ratio") <= most_failed) & (F.col("p95") <= slowest)).alias("ok"))


def recall(want: Column, got: Column) -> Column:
    """Share of the wanted that was got, 0 where nothing is wanted."""
    w = F.array_distinct(want)
    return F.when(F.size(w) > 0, F.round(F.size(F.array_intersect(w, got)) / F.size(w), 4)).otherwise(0.0)


def retrieval_cases(cases: DataFrame, hits: DataFrame, least: float = 0.15, threshold: float = 0.5) -> DataFrame:
    """(query_id, metric, score, threshold, success) of retrieval cases.

    cases(query_id, negative), hits(query_id, fused). A negative case asks for what is not there: it scores 1 if nothing
    is found. The others score the relevancy of their hits.
    """
    found = hits.groupBy("query_id").agg(F.collect_list("fused").alias("scores"))
    rows = cases.join(found, "query_id", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))
    score = F.when(F.col("negative"), F.when(F.size("scores") == 0, 1.0).otherwise(0.0)).otherwise(relevancy(F.array_sort("scores"), least))
    rows = rows.select("query_id", F.when(F.col("negative"), "Negative Rejection").otherwise("Retrieval Relevancy").alias("metric"), F.round(score + 1e-9, 6).alias("score"), F.when(F.col("negative"), 1.0).otherwise(threshold).alias("threshold"))
    return rows.withColumn("success", F.col("score") >= F.col("threshold"))


def pass_gate(cases: DataFrame, least: float) -> DataFrame:
    """One row: cases, their pass rate, and whether it is at least ``least``; without cases the rate is 0."""
    agg = case_scores(cases).agg(F.count("*").alias("n_cases"), F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0)).alias("rate"))
    return agg.select("n_cases", F.round("rate", 6).alias("pass_rate"), (F.col("rate") >= least).alias("ok"))


def code_lines(c) -> Column:
    """Stripped lines that are not blank."""
    lines = F.transform(F.split(F.regexp_replace(c, r"\r\n|\r", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    return F.filter(lines, lambda x: x != "")


def row_retention(before: DataFrame, after: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, kept) of keys in both: the share of the lines of ``before`` that are lines of ``after``; 0 without lines.

    Keys are unique on both sides. Lines meet by a join, so that long codes cost no more than their lines.
    """
    own = before.select(key, F.explode(code_lines(F.col(code))).alias("line")).groupBy(key, "line").agg(F.count("*").alias("n"))
    there = after.select(key, F.explode(F.array_distinct(code_lines(F.col(code)))).alias("line"), F.lit(1).alias("there"))
    share = own.join(there, [key, "line"], "left").groupBy(key).agg((F.sum(F.when(F.col("there") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("kept"))
    both = before.select(key).join(after.select(key), key)
    return both.join(share, key, "left").select(key, F.coalesce("kept", F.lit(0.0)).alias("kept"))
