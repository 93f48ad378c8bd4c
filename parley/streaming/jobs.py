"""The engine's aggregates over event streams: windows with watermarks, duplicates, and the repeat ledger as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..rules import ESCALATE_AT, REPEAT_WINDOW


def timed(stream: DataFrame, time_col: str, late: str) -> DataFrame:
    """The stream with a watermark; times without a zone count as the session's."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def tumbling_counts(stream: DataFrame, time_col: str, by: str, width: str = "6 hours", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per window and group; rows later than `late` are left out, windows are emitted when they can't change."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return timed(stream, time_col, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(stream: DataFrame, time_col: str, key: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return timed(stream, time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_within(stream: DataFrame, time_col: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First row of each key while its watermark lasts, so state is bounded."""
    return timed(stream, time_col, late).dropDuplicatesWithinWatermark(keys)


LEDGER_STATE = "repeat_count int, last_turn int"
LEDGER_OUT = "conv_id long, ledger_type string, entry_key string, turn_idx int, repeat_count int, status string"


def repeat_step(count: int, last: int | None, turn: int, resolved: bool, window: int = REPEAT_WINDOW, escalate_at: int = ESCALATE_AT) -> tuple[int, str]:
    """(repeat_count, status) of one event after the state (count, last turn)."""
    if resolved:
        return 0, "RESOLVED"
    if last is None:
        return 1, "NEW"
    count = count + 1 if turn - last <= window else 1
    return count, "ESCALATED" if count >= escalate_at else "REPEATED" if count >= 2 else "NEW"


def repeat_ledger(stream: DataFrame, time_col: str = "ts", late: str = "1 hour", idle: str = "30 days", window: int = REPEAT_WINDOW, escalate_at: int = ESCALATE_AT) -> DataFrame:
    """Decisions as events (conv_id, ledger_type, entry_key, turn_idx, resolved, time) come in, the same as ledger.repeat_chains gives on the whole table.

    A key is that of the batch ledger. Its state is two numbers and ends when the watermark is `idle` past its latest event: by the events' own
    time, so results don't depend on when the query runs; `idle` is to be longer than a conversation rests. Turns of a key are taken in order within a
    micro-batch; a turn that comes later than a higher one counts from the last turn seen."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches))
        until = int(rows["_millis"].max()) + wait
        rows = rows.sort_values("turn_idx", kind="stable")
        out = []
        for turn, resolved in zip(rows["turn_idx"], rows["resolved"], strict=True):
            count, status = repeat_step(count, last, int(turn), bool(resolved), window, escalate_at)
            last = int(turn)
            out.append((*key, last, count, status))
        state.update((count, last))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conv_id", "ledger_type", "entry_key", "turn_idx", "repeat_count", "status"])

    keyed = timed(stream, time_col, late).withColumn("_millis", F.unix_millis(time_col))
    return keyed.groupBy("conv_id", "ledger_type", "entry_key").applyInPandasWithState(step, LEDGER_OUT, LEDGER_STATE, "append", GroupStateTimeout.EventTimeTimeout)
