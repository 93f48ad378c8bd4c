"""Annotations by two raters: items from detected events, normalisation of raw items and of rated cases, blank templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..rules import AXES, REPORT_RANK, SEVERITY_RANK, lookup
from .agreement import MOST_SEVERE

# Confidence of items from events and of items that name none, targets of a batch.
EVENT_CONFIDENCE, DEFAULT_CONFIDENCE, TARGET = 0.95, 0.8, 100
ITEM = ["conv_id", "turn_id", "rater", "axis", "event_code", "severity", "confidence", "notes"]


def event_items(events: DataFrame, signals: DataFrame, raters: tuple[str, ...] = ("rater_A", "rater_B")) -> DataFrame:
    """An item for each event, signal and rater; signals stand under the axis VCD."""
    turn = F.coalesce(blank_to_null(F.col("turn_id")), F.lit("T001"))
    rank = lookup(SEVERITY_RANK, F.col("severity"), 0)
    first = events.select("conv_id", turn.alias("turn_id"), "axis", F.col("rule_id").alias("event_code"), rank.alias("severity"), F.lit("event-engine-match").alias("notes"))
    second = signals.select("conv_id", turn.alias("turn_id"), F.lit("VCD").alias("axis"), F.col("rule_id").alias("event_code"), rank.alias("severity"), F.lit("vcd-match").alias("notes"))
    return first.unionByName(second).withColumn("rater", F.explode(F.array(*map(F.lit, raters)))).withColumn("confidence", F.lit(EVENT_CONFIDENCE)).select(*ITEM)


def normalized_items(raw: DataFrame, rater: str = "rater_A") -> DataFrame:
    """Items of raw rows, whose columns may be named in either style (turn_id or turnId, and so on) or be missing: codes in capitals, the axis from the
    code where none is given, severity within 0 to MOST_SEVERE (0 if no number), confidence within 0 to 1 (DEFAULT_CONFIDENCE if no number).
    Items without a turn go."""
    # names match in either case, so the snake and the camel form are enough
    there = {c.lower(): c for c in raw.columns}

    def field(*names: str):
        found = [F.col(f"`{there[n.lower()]}`").cast("string") for n in names if n.lower() in there]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def number(name: str, most: float, otherwise: float):
        value = field(name).try_cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), value))).otherwise(F.lit(float(otherwise)))

    code = F.upper(F.btrim(F.coalesce(field("event_code", "eventCode"), F.lit("UNSPECIFIED"))))
    turn = F.btrim(F.coalesce(field("turn_id", "turnId"), F.lit("")))
    rows = raw.select(
        blank_to_null(field("conversation_id", "conversationId", "conv_id")).alias("conv_id"), turn.alias("turn_id"), F.coalesce(blank_to_null(field("rater_id", "raterId", "rater")), F.lit(rater)).alias("rater"),
        F.upper(F.btrim(F.coalesce(field("axis"), F.split_part(code, F.lit("_"), F.lit(1))))).alias("axis"), code.alias("event_code"), number("severity", MOST_SEVERE, 0).alias("severity"),
        number("confidence", 1, DEFAULT_CONFIDENCE).alias("confidence"), F.btrim(F.coalesce(field("notes"), F.lit(""))).alias("notes"),
    )
    return rows.where("turn_id <> ''").select(*ITEM)


def template(turns: DataFrame, batch_id: str = "pilot-study-001", target: int = TARGET) -> DataFrame:
    """A blank batch entry for each conversation: its turns with an id, and empty lists for both raters."""
    usable = turns.where(F.btrim("turn_id") != "")
    one = F.struct("turn_idx", F.btrim("turn_id").alias("turn_id"), F.coalesce(blank_to_null(F.lower("role")), F.lit("unknown")).alias("role"), F.btrim(F.coalesce("text", F.lit(""))).alias("text"))
    nested = usable.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda t: F.struct(t["turn_id"], t["role"], t["text"])).alias("turns"))
    none = F.expr("cast(array() as array<struct<turn_id:string,event_code:string,severity:double,confidence:double,notes:string>>)")
    return nested.select(F.lit(batch_id).alias("batch_id"), F.lit(target).alias("target_count"), F.lit(0).alias("completed_count"), F.col("conv_id").alias("conversation_id"), "turns", none.alias("rater_a"), none.alias("rater_b"), F.lit(None).cast("double").alias("cohens_kappa"))


def rated_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cases: case_id, and for both raters (prefix a_ or b_) risk_status, scores (map of axis to number) and rules (array). -> cases with trimmed status, scores of
    all axes (0 where missing) and distinct sorted rules; and (case_id, errors) of those with an unknown status, a score outside 0 to 100, or no id."""

    def status(r):
        return F.btrim(F.coalesce(F.col(f"{r}_risk_status"), F.lit("")))

    def score(r, axis):
        return F.coalesce(F.try_element_at(f"{r}_scores", F.lit(axis)).cast("double"), F.lit(0.0))

    faults = [F.when(F.btrim(F.coalesce(F.col("case_id").cast("string"), F.lit(""))) == "", F.lit("case without id"))]
    for r in ("a", "b"):
        faults.append(F.when(~status(r).isin(*REPORT_RANK), F.lit(f"{r}: risk_status")))
        faults += [F.when(~score(r, axis).between(0, 100), F.lit(f"{r}: {axis} outside 0 to 100")) for axis in AXES]
    judged = cases.withColumn("errors", F.array_compact(F.array(*faults)))
    columns = ["case_id"]
    for r in ("a", "b"):
        rules = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(f"{r}_rules", F.array().cast("array<string>")), lambda x: F.btrim(x)), lambda x: x != "")))
        columns += [status(r).alias(f"{r}_status"), *(score(r, axis).alias(f"{r}_{axis}") for axis in AXES), rules.alias(f"{r}_rules")]
    return judged.where(F.size("errors") == 0).select(*columns), judged.where(F.size("errors") > 0).select("case_id", "errors")
