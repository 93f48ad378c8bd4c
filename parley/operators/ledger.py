"""Repeat ledger: chains of one entry's events in a conversation, by gaps and islands on the turn clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import ESCALATE_AT, LEDGER_OF_AXIS, REPEAT_WINDOW, lookup


def ledger_events(found: DataFrame) -> DataFrame:
    """Unified events as ledger events; ord_key orders events of one turn."""
    tag = F.when(F.col("source") == "event-engine", "ee").otherwise("vcd")
    return found.select("conv_id", "event_id", lookup(LEDGER_OF_AXIS, F.col("axis"), "context").alias("ledger_type"), F.concat(tag, F.lit(":"), F.lower("rule_id")).alias("entry_key"), "turn_idx", F.struct("src_ord", "ord").alias("ord_key"), F.lit(False).alias("resolved"), "axis", F.col("summary").alias("note"))


def cross_ledger_rejects(events: DataFrame) -> DataFrame:
    """events with `rejected`: the entry's key belongs to the ledger where it came up first."""
    owner = F.first("ledger_type").over(Window.partitionBy("conv_id", "entry_key").orderBy("turn_idx", "ord_key"))
    return events.withColumn("rejected", owner != F.col("ledger_type"))


def repeat_chains(events: DataFrame, window: int = REPEAT_WINDOW, escalate_at: int = ESCALATE_AT) -> DataFrame:
    """events with repeat_count and status: NEW, REPEATED, ESCALATED, RESOLVED. A chain ends at a resolved event or a gap of more than window turns."""
    own = Window.partitionBy("conv_id", "ledger_type", "entry_key").orderBy("turn_idx", "ord_key")
    last, was_resolved = F.lag("turn_idx").over(own), F.lag("resolved").over(own)
    broken = last.isNull() | was_resolved | (F.col("turn_idx") - last > window)
    marked = events.withColumn("_first", last.isNull()).withColumn("_island", F.sum(broken.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("conv_id", "ledger_type", "entry_key", "_island").orderBy("turn_idx", "ord_key").rowsBetween(Window.unboundedPreceding, 0)
    count = F.when(F.col("resolved"), F.lit(0)).otherwise(F.sum((~F.col("resolved")).cast("int")).over(chain))
    counted = marked.withColumn("repeat_count", count.cast("int"))
    n = F.col("repeat_count")
    status = F.when(F.col("resolved"), "RESOLVED").when(F.col("_first"), "NEW").when(n >= escalate_at, "ESCALATED").when(n >= 2, "REPEATED").otherwise("NEW")
    return counted.withColumn("status", status).drop("_first", "_island")


def event_errors(most_span: int = 50) -> F.Column:
    """First fault of a ledger event's row (ledger_type, entry_key, turn_idx, range_start, range_end); null if there is none."""
    start, end = F.col("range_start"), F.col("range_end")
    return (
        F.when(~F.coalesce(F.col("ledger_type"), F.lit("")).isin("fact", "commitment", "context"), "input-ledgerType-invalid")
        .when(F.btrim(F.coalesce(F.col("entry_key"), F.lit(""))) == "", "input-entryKey-missing")
        .when(F.coalesce(F.col("turn_idx"), F.lit(-1)) < 0, "input-turn-index-invalid")
        .when(start.isNull() | end.isNull(), "input-turn-range-invalid")
        .when(start > end, "input-turn-range-order")
        .when(~F.col("turn_idx").between(start, end), "input-turn-range-contains")
        .when(end - start > most_span, "input-turn-range-span")
    )


def ledger_summary(rows: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("ledger_type") == t).alias(f"{t}_entries") for t in ("fact", "commitment", "context")]
    states = [F.count_if(F.col("status") == s.upper()).alias(f"{s}_rows") for s in ("repeated", "escalated", "resolved")]
    return rows.groupBy("conv_id").agg(*kinds, F.countDistinct("ledger_type", "entry_key").alias("signatures"), *states)
