"""Levels, axis scores, state, evidence: one row per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..rules import AXES, AXIS_FLOORS, EVIDENCE_ITEMS, NO_EVIDENCE, SUBTYPES, TAG_LEVELS, TAG_OF_AXIS, TAG_SEVERITY, TAG_WEIGHTS, TIE_ORDER, VOLUME_BONUS_AT, lookup


def tag_buckets(found: DataFrame) -> DataFrame:
    """conv_id, tag_axis, severity, n, weighted."""
    tag = lookup(TAG_OF_AXIS, F.col("axis"), "SYS").alias("tag_axis")
    counted = found.groupBy("conv_id", tag, "severity").agg(F.count("*").alias("n"))
    weight = lookup(TAG_WEIGHTS, F.col("tag_axis"), "0").cast("decimal(4,1)")
    return counted.withColumn("weighted", (weight * lookup(TAG_SEVERITY, F.col("severity"), 0) * F.col("n")).cast("decimal(18,1)"))


def level_of(score) -> F.Column:
    return F.when(score >= TAG_LEVELS["HIGH"], "HIGH").when(score >= TAG_LEVELS["MEDIUM"], "MEDIUM").otherwise("LOW")


def tag_levels(buckets: DataFrame, conversations: DataFrame, previous: DataFrame | None = None, stable_needed: int = 2) -> DataFrame:
    """total_score, base_level, final_level, next_stable_rounds, critical_events, medium_axes. previous: conv_id, level, stable_rounds of earlier runs.

    A critical event, or two axes at medium or above, make the level HIGH; a level doesn't fall before stable_needed stable rounds."""
    medium = F.col("severity").isin("medium", "high", "critical")
    own = buckets.groupBy("conv_id").agg(F.sum("weighted").alias("total_score"), F.count_if(F.col("severity") == "critical").alias("critical_events"), F.countDistinct(F.when(medium, F.col("tag_axis"))).alias("medium_axes"))
    whole = conversations.select("conv_id").join(own, "conv_id", "left")
    whole = whole.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_score", "critical_events", "medium_axes")))
    whole = whole.withColumn("base_level", level_of(F.col("total_score"))).withColumn("candidate", F.when((F.col("critical_events") > 0) | (F.col("medium_axes") >= 2), "HIGH").otherwise(F.col("base_level")))
    if previous is None:
        return whole.withColumn("final_level", F.col("candidate")).withColumn("next_stable_rounds", F.lit(0)).drop("candidate")
    rank = lambda c: lookup({"LOW": 0, "MEDIUM": 1, "HIGH": 2}, c, 0)
    held = whole.join(previous.select("conv_id", "level", "stable_rounds"), "conv_id", "left")
    frozen = F.coalesce((rank(F.col("level")) > rank(F.col("candidate"))) & (F.col("stable_rounds") < stable_needed), F.lit(False))
    return held.withColumn("final_level", F.when(frozen, F.col("level")).otherwise(F.col("candidate"))).withColumn("next_stable_rounds", F.when(frozen, F.col("stable_rounds") + 1).otherwise(0)).drop("candidate", "level", "stable_rounds")


def level_history(sessions: DataFrame, stable_needed: int = 2) -> DataFrame:
    """conv_id, rounds: array of struct(seq, level, stable) after each of a conversation's sessions (conv_id, seq, level): a fold in order."""
    rank = lambda c: lookup({"LOW": 0, "MEDIUM": 1, "HIGH": 2}, c, 0)
    start = F.struct(F.lit("LOW").alias("level"), F.lit(0).alias("stable"), F.expr("cast(array() as array<struct<seq:bigint,level:string,stable:int>>)").alias("rounds"))

    def step(s, x):
        frozen = (rank(s["level"]) > rank(x["level"])) & (s["stable"] < stable_needed)
        level, stable = F.when(frozen, s["level"]).otherwise(x["level"]), F.when(frozen, s["stable"] + 1).otherwise(F.lit(0))
        return F.struct(level.alias("level"), stable.alias("stable"), F.concat(s["rounds"], F.array(F.struct(x["seq"].cast("bigint").alias("seq"), level.alias("level"), stable.alias("stable")))).alias("rounds"))

    ordered = sessions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "level"))).alias("s"))
    return ordered.select("conv_id", F.aggregate("s", start, step, lambda s: s["rounds"]).alias("rounds"))


def axis_scores(found: DataFrame, ledger: DataFrame, summary: DataFrame) -> DataFrame:
    """Scores fr, ca, sr, sa from 0 to 4 with counts n_fr... : highest severity, bonus for volume, floor by signal status, bonus for escalation."""
    counts = found.groupBy("conv_id").agg(*(x for a in AXES for x in (F.max(F.when(F.col("axis") == a, F.col("sev_rank"))).alias(f"s_{a}"), F.count_if(F.col("axis") == a).alias(f"n_{a}"))))
    escalated = ledger.where("status = 'ESCALATED'").groupBy("conv_id").agg(*(F.count_if(F.col("axis") == a).alias(f"e_{a}") for a in AXES))
    whole = summary.select("conv_id", F.col("status").alias("_status")).join(counts, "conv_id", "left").join(escalated, "conv_id", "left")
    out = []
    for a in AXES:
        score = F.coalesce(F.col(f"s_{a}"), F.lit(0))
        score = F.when((F.col(f"n_{a}") >= VOLUME_BONUS_AT) & (score > 0), F.least(F.lit(4), score + 1)).otherwise(score)
        score = F.greatest(score, lookup({s: f[a] for s, f in AXIS_FLOORS.items() if a in f}, F.col("_status"), 0))
        score = F.when((F.coalesce(F.col(f"e_{a}"), F.lit(0)) > 0) & (score > 0), F.least(F.lit(4), score + 1)).otherwise(score)
        out += [score.alias(a.lower()), F.coalesce(F.col(f"n_{a}"), F.lit(0)).alias(f"n_{a.lower()}")]
    return whole.select("conv_id", *out)


def state(scores: DataFrame) -> DataFrame:
    """scores with overall, ps, sub, sub_axis, high_axes, f_triggered, f_level, f_reasons."""
    overall = F.greatest(*(F.col(a.lower()) for a in AXES))
    high = sum((F.col(a.lower()) >= 3).cast("int") for a in AXES)
    axis = F.coalesce(*(F.when(F.col("overall") == F.col(a.lower()), F.lit(a)) for a in TIE_ORDER))
    found = scores.withColumn("overall", overall).withColumn("high_axes", high)
    found = found.withColumn("ps", F.when(F.col("overall") <= 1, "ST_NRM").when(F.col("overall") >= 4, "ST_ALM").otherwise("ST_DEV")).withColumn("sub_axis", F.when(F.col("overall") > 0, axis))
    reasons = F.array_compact(F.array(F.when(F.col("overall") >= 4, "score-threshold"), F.when(F.col("high_axes") >= 2, "multi-high-axis")))
    return found.withColumn("sub", F.when((F.col("ps") == "ST_NRM") | F.col("sub_axis").isNull(), "SUB_NONE").otherwise(lookup(SUBTYPES, F.col("sub_axis")))).withColumn("f_reasons", reasons).withColumn("f_triggered", F.size("f_reasons") > 0).withColumn("f_level", F.concat(F.lit("F"), F.col("overall").cast("string")))


def evidence(found: DataFrame) -> DataFrame:
    """conv_id, place, axis, turn_id, summary: by severity, turn and id; summaries squeezed, 200 characters."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("sev_rank"), "turn_idx", F.collate("event_id", "UNICODE"))
    short = F.substring(squeezed(F.col("summary")), 1, 200)
    return found.select("conv_id", F.row_number().over(order).alias("place"), "axis", "turn_id", "event_id", short.alias("summary")).where(F.col("summary") != "")


def top_evidence(rows: DataFrame, states: DataFrame, items: int = EVIDENCE_ITEMS) -> DataFrame:
    """conv_id, e: the best distinct pieces of evidence, the dominant axis first, then by axis score and place."""
    score = lookup({}, F.col("axis"), 0)
    for a in AXES:
        score = F.when(F.col("axis") == a, F.col(a.lower())).otherwise(score)
    ranked = rows.join(states.select("conv_id", "sub_axis", *(a.lower() for a in AXES)), "conv_id").withColumn("_key", F.struct((~F.coalesce(F.col("axis") == F.col("sub_axis"), F.lit(False))).alias("a"), (-score).alias("b"), F.col("place").alias("c")))
    distinct = ranked.groupBy("conv_id", "axis", "turn_id", "summary").agg(F.min("_key").alias("_key"))
    best = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("_key"))).where(F.col("_n") <= items)
    line = F.btrim(F.concat("axis", F.lit(":"), "turn_id", F.lit(" "), "summary"))
    joined = best.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), " | ").alias("e"))
    return states.select("conv_id").join(joined, "conv_id", "left").fillna({"e": NO_EVIDENCE})
