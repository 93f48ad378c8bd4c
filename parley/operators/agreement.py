"""Agreement of raters and quality of labels: kappa, ICC, Jaccard, confusion, descriptive statistics. All by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the highest severity of an annotation.
MOST_SEVERE = 4


def kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None, decimals: int = 6, empty: float | None = 0.0) -> DataFrame:
    """Unweighted Cohen's kappa with n and observed and expected agreement, over all or for each group. Expected agreement 1: kappa is 1 if observed is 1, else 0."""
    by = by or []
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(F.count("*").alias("_n"))
    key = by or [F.lit(1).alias("_one")]
    names = by or ["_one"]
    total = cells.groupBy(*key).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    rows = cells.groupBy(*key, F.col("_a").alias("_c")).agg(F.sum("_n").alias("_r"))
    columns = cells.groupBy(*key, F.col("_b").alias("_c")).agg(F.sum("_n").alias("_k"))
    chance = rows.join(columns, [*names, "_c"]).groupBy(*names).agg(F.sum(F.col("_r") * F.col("_k")).alias("_chance"))
    po, pe = F.col("_same") / F.col("n"), F.coalesce(F.col("_chance"), F.lit(0)) / (F.col("n") * F.col("n"))
    value = F.when(F.col("n") == 0, F.lit(empty)).when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return total.join(chance, names, "left").select(*by, "n", F.round(po, decimals).alias("observed"), F.round(pe, decimals).alias("expected"), F.round(value, decimals).alias("kappa"))


def icc_2_1(pairs: DataFrame, a: str, b: str, decimals: int = 6) -> DataFrame:
    """Two-way random, single-rater intraclass correlation of two raters, in one pass of sums."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_samp((x + y) / 2).alias("vt"), F.var_samp((x - y) / 2).alias("vd"))
    # mean squares of targets, raters and error, of k = 2 raters
    msr = 2 * F.col("vt")
    msc = F.col("n") * (F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")) / 2
    mse = 2 * F.col("vd")
    below = msr + mse + F.lit(2.0) / F.col("n") * (msc - mse)
    return s.select("n", F.round(F.when((F.col("n") > 1) & (below != 0), (msr - mse) / below), decimals).alias("icc"))


def jaccard(left, right) -> F.Column:
    """Of two arrays as sets; both empty: 1."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def rule_agreement(rows: DataFrame, a: str, b: str, decimals: int = 6) -> DataFrame:
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("double")), decimals).alias("exact_match"), F.round(F.avg(jaccard(F.col(a), F.col(b))), decimals).alias("macro_jaccard"), F.count_if(~same).alias("disagreements"))


def axis_agreement(rows: DataFrame, axes: list[str], decimals: int = 6) -> DataFrame:
    """axis, means of both raters and largest difference, of columns a_<axis> and b_<axis>."""
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("axis"), F.col(f"a_{x}").cast("double").alias("a"), F.col(f"b_{x}").cast("double").alias("b")) for x in axes)))
    flat = rows.select(pairs.alias("p")).select("p.*")
    return flat.groupBy("axis").agg(F.round(F.avg("a"), decimals).alias("mean_a"), F.round(F.avg("b"), decimals).alias("mean_b"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), decimals).alias("max_difference"))


def severity_units(units: DataFrame, ratings: DataFrame) -> DataFrame:
    """conv_id, turn_id, a, b: each rater's highest severity (within 0 to MOST_SEVERE; 0 if no finite number) of a turn, 0 where it has none. Units are the given turns and all rated ones."""
    number = F.col("severity").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    bounded = F.when(~finite, 0).when(number < 0, 0).when(number > MOST_SEVERE, MOST_SEVERE).otherwise(F.col("severity"))
    worst = ratings.withColumn("severity", bounded).groupBy("conv_id", "turn_id").agg(*(F.max(F.when(F.col("rater") == r, F.col("severity"))).alias(r) for r in ("a", "b")))
    return units.select("conv_id", "turn_id").distinct().join(worst, ["conv_id", "turn_id"], "full_outer").fillna(0, ["a", "b"])


def batch_irr(units: DataFrame, decimals: int = 4) -> DataFrame:
    """Kappa and agreement of conversations, weighted by their units."""
    own = kappa(units, "a", "b", ["conv_id"], decimals=12)
    weighted = lambda c: F.round(F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n")), decimals)
    return own.agg(F.count("*").alias("conversations"), F.sum("n").alias("units"), weighted("kappa").alias("kappa"), weighted("observed").alias("agreement"))


def progress(batches: DataFrame) -> DataFrame:
    """Of conversations with a_items, b_items per batch: completed, pending and rate."""
    done = F.greatest(F.max(F.coalesce("declared", F.lit(0))), F.count_if((F.col("a_items") > 0) & (F.col("b_items") > 0)))
    return batches.groupBy("batch_id").agg(F.count("*").alias("target"), done.alias("completed")).withColumn("pending", F.greatest(F.lit(0), F.col("target") - F.col("completed"))).withColumn("rate", F.round(F.try_divide("completed", "target"), 4))


def confusion(rows: DataFrame, truth, predicted, decimals: int = 6) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, f1, accuracy, specificity of two boolean columns."""
    cells = rows.agg(*(F.count_if(c).alias(n) for n, c in (("tp", truth & predicted), ("fp", ~truth & predicted), ("fn", truth & ~predicted), ("tn", ~truth & ~predicted))))
    share = lambda up, down: F.round(up / F.greatest(down, F.lit(1)), decimals)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tn, tn + fp).alias("specificity"))


def descriptive(rows: DataFrame, value: str, by: list[str], decimals: int = 4) -> DataFrame:
    """n, mean, sample standard deviation (0 for one value), min, max and median."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(v), decimals).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), decimals).alias("std"), F.round(F.min(v), decimals).alias("min"), F.round(F.max(v), decimals).alias("max"), F.round(F.percentile(v, F.lit(0.5)), decimals).alias("median"))


def label_metrics(base: DataFrame, candidate: DataFrame, key: str, label: str, normal: str = "Normal", decimals: int = 6) -> DataFrame:
    """Exact-match accuracy and false-positive and -negative rates of labels that aren't `normal`, on the keys of both."""
    both = base.select(key, F.col(label).alias("_b")).join(candidate.select(key, F.col(label).alias("_c")), key)
    b, c = F.col("_b") != normal, F.col("_c") != normal
    rate = lambda up, down: F.round(F.coalesce(F.try_divide(F.count_if(up), F.count_if(down)), F.lit(0.0)), decimals)
    return both.agg(F.count("*").alias("compared"), rate(F.col("_b") == F.col("_c"), F.lit(True)).alias("accuracy"), rate(~b & c, ~b).alias("false_positive_rate"), rate(b & ~c, b).alias("false_negative_rate"))


def arbitration_queue(cases: DataFrame) -> DataFrame:
    """Cases whose raters differ: columns case_id, a_status, b_status, a_rules, b_rules."""
    status = F.col("a_status") != F.col("b_status")
    rules = (F.size(F.array_except("a_rules", "b_rules")) > 0) | (F.size(F.array_except("b_rules", "a_rules")) > 0)
    return cases.where(status | rules).select("case_id", status.alias("status_differs"), rules.alias("rules_differ"))
