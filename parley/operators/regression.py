"""Comparison of runs: outputs of two suites by case, mismatch kinds, rates, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json


def mismatch_kind(left, right) -> F.Column:
    """Of two JSON texts that differ: type, structure (objects or arrays), text or value."""
    kind = lambda x: F.regexp_extract(F.schema_of_variant(F.try_parse_json(x)), r"^(\w+)", 1)
    folded = lambda x: F.when(kind(x).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), "NUMBER").otherwise(kind(x))
    a, b = folded(left), folded(right)
    return F.when(a != b, "type").when(a.isin("OBJECT", "ARRAY"), "structure").when(a == "STRING", "text").otherwise("value")


def compare(base: DataFrame, candidate: DataFrame, key: str = "case_id", output: str = "output") -> DataFrame:
    """case, result (match, mismatch, missing, unexpected) and kind of mismatch, by a full outer join."""
    left = base.select(key, canonical_json(F.col(output)).alias("_b"), F.lit(True).alias("_in_b"))
    right = candidate.select(key, canonical_json(F.col(output)).alias("_c"), F.lit(True).alias("_in_c"))
    both = left.join(right, key, "full_outer")
    result = F.when(F.col("_in_c").isNull(), "missing").when(F.col("_in_b").isNull(), "unexpected").when(F.col("_b").eqNullSafe(F.col("_c")), "match").otherwise("mismatch")
    return both.select(key, result.alias("result"), F.when(result == "mismatch", mismatch_kind(F.col("_b"), F.col("_c"))).alias("kind"))


def summary(compared: DataFrame, decimals: int = 6) -> DataFrame:
    """Counts of results, pass rate over the base's cases (1 for an empty base without unexpected cases)."""
    n = {r: F.count_if(F.col("result") == r).alias(r) for r in ("match", "mismatch", "missing", "unexpected")}
    counted = compared.agg(*n.values())
    base = F.col("match") + F.col("mismatch") + F.col("missing")
    rate = F.when(base == 0, F.when(F.col("unexpected") == 0, 1.0).otherwise(0.0)).otherwise(F.col("match") / base)
    return counted.withColumn("pass_rate", F.round(rate, decimals)).withColumn("passed", (F.col("mismatch") + F.col("missing") + F.col("unexpected")) == 0)


def trend(runs: DataFrame, order_col: str, rate_col: str, by: list[str]) -> DataFrame:
    """Each run's change of rate against the run before it."""
    return runs.withColumn("delta", F.round(F.col(rate_col) - F.lag(rate_col).over(Window.partitionBy(*by).orderBy(order_col)), 6))


def thresholds(metrics: DataFrame, at_least: dict[str, float], at_most: dict[str, float]) -> DataFrame:
    """metrics with the names of those that miss their bars, and PASS or FAIL."""
    missed = F.array_compact(F.array(*(F.when(F.col(k) < v, F.lit(k)) for k, v in at_least.items()), *(F.when(F.col(k) > v, F.lit(k)) for k, v in at_most.items())))
    return metrics.withColumn("missed", missed).withColumn("decision", F.when(F.size("missed") == 0, "PASS").otherwise("FAIL"))
