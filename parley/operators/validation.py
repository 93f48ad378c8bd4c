"""Validation: stages against their bars, readiness, pilot plans, dataset summaries for corpus building."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Stage, its metric and the least value that passes.
STAGES = [("content", "content_validity", 0.80), ("construct", "construct_fit", 0.90), ("criterion", "criterion_correlation", 0.50), ("irr", "kappa", 0.61), ("retest", "retest_correlation", 0.70)]


def evaluate_stages(metrics: DataFrame, key: str) -> DataFrame:
    """key, stage, metric, threshold, value, status (passed, failed, pending) of columns named as the metrics; a missing or unreadable metric is pending."""
    there = {m for _, m, _ in STAGES} & set(metrics.columns)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(m).alias("metric"), F.lit(t).alias("threshold"), (F.col(m).cast("string").try_cast("double") if m in there else F.lit(None).cast("double")).alias("value")) for s, m, t in STAGES)))
    rows = metrics.select(key, each.alias("x")).select(key, "x.*")
    return rows.withColumn("status", F.when(F.col("value").isNull(), "pending").when(F.col("value") >= F.col("threshold"), "passed").otherwise("failed"))


def readiness(stages: DataFrame, key: str) -> DataFrame:
    """ready if all stages passed, not_ready if one failed, else unknown."""
    counts = stages.groupBy(key).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "passed").alias("passed"))
    return counts.withColumn("readiness", F.when(F.col("failed") > 0, "not_ready").when(F.col("pending") > 0, "unknown").otherwise("ready"))


def normalized_readiness(value) -> F.Column:
    x = F.lower(F.btrim(value))
    return F.when(x.isin("ready", "empirical_ready"), "ready").when(x == "unknown", "unknown").otherwise("not_ready")


def pilot_errors(plan: dict[str, int], total: int) -> list[str]:
    """What is wrong with a pilot study's distribution of cases."""
    errors = [f"{k}: not a whole number from 0" for k, v in plan.items() if not isinstance(v, int) or v < 0]
    return errors or ([f"adds up to {sum(plan.values())}, not {total}"] if sum(plan.values()) != total else [])


def quota(rows: DataFrame, group_col: str, order_col: str, size: int) -> DataFrame:
    """The first `size` rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group_col).orderBy(order_col))).where(F.col("place") <= size)


def rule_gaps(observed: DataFrame, known: DataFrame) -> DataFrame:
    """rule_id and state: seen, missing (known but not observed), unknown (observed but not known)."""
    seen = observed.select("rule_id").distinct().withColumn("o", F.lit(True))
    both = known.select("rule_id").distinct().withColumn("k", F.lit(True)).join(seen, "rule_id", "full_outer")
    return both.select("rule_id", F.when(F.col("o").isNull(), "missing").when(F.col("k").isNull(), "unknown").otherwise("seen").alias("state"))


def nested_profile(rows: DataFrame, list_col: str, by: list[str]) -> DataFrame:
    """Per group: rows, elements, empty lists, largest list and lists by size (map)."""
    size = F.coalesce(F.size(list_col), F.lit(0))
    counted = rows.groupBy(*by, size.alias("size")).agg(F.count("*").alias("n"))
    sizes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "n"))))
    return counted.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("elements"), F.sum(F.when(F.col("size") == 0, F.col("n")).otherwise(0)).alias("empty"), F.max("size").alias("largest"), sizes.alias("sizes"))
