"""The whole analysis of conversations: turns in, a report row per conversation out."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deid, events, gate, ledger, scores
from ..rules import CAP, ESCALATE_AT, EVENT_RULES, REPEAT_WINDOW, REPORT_RANK, REVIEW_NOTE, SCHEMA_VERSION, SIGNAL_RULES, lookup
from ..storage import saved


@dataclass(frozen=True)
class Config:
    """What a run can change. Rules are (id, group, severity, mode, phrases)."""

    event_rules: list[tuple] | None = None
    signal_rules: list[tuple] | None = None
    cap: int = CAP
    repeat_window: int = REPEAT_WINDOW
    escalate_at: int = ESCALATE_AT
    deidentify: bool = True
    most_per_type: int | None = None  # personal data of a type in a turn; what is beyond stays and is warned of
    gate: dict = field(default_factory=dict)


@dataclass
class Run:
    """The stages' DataFrames. Events and signals are computed when run() is called, the rest when it is used."""

    turns: DataFrame
    conversations: DataFrame
    replacements: DataFrame | None
    events: DataFrame
    signals: DataFrame
    summary: DataFrame
    unified: DataFrame
    ledger: DataFrame
    buckets: DataFrame
    tags: DataFrame
    axes: DataFrame
    state: DataFrame
    evidence: DataFrame
    top: DataFrame
    report: DataFrame


def max_status(*columns) -> F.Column:
    best = F.greatest(*(lookup(REPORT_RANK, c, 0) for c in columns))
    return lookup({v: k for k, v in REPORT_RANK.items()}, best, "Normal")


def run(turns: DataFrame, config: Config = Config()) -> Run:
    found = saved(deid.replacements(turns, most_per_type=config.most_per_type), "replacements") if config.deidentify else None
    warned = deid.skipped(turns, config.most_per_type) if config.deidentify and config.most_per_type is not None else None
    # seven stages read the clean turns, and finding personal data is the dearest of all: done once
    clean = saved(deid.redact(turns, found), "clean") if config.deidentify else turns
    conversations = turns.groupBy("conv_id").agg(F.count("*").alias("turn_count"))
    # hits are few beside turns and five stages read them: computed once
    event = saved(events.risk_events(clean, config.event_rules, config.cap), "events")
    signal = saved(events.signals(clean, config.signal_rules, config.cap), "signals")
    summary = events.signal_summary(signal, conversations)
    every = events.unified(event, signal)
    chains = ledger.repeat_chains(ledger.ledger_events(every), config.repeat_window, config.escalate_at)
    buckets = scores.tag_buckets(every)
    tags = scores.tag_levels(buckets, conversations)
    axes = scores.axis_scores(every, chains, summary)
    states = scores.state(axes)
    rows = scores.evidence(every)
    top = scores.top_evidence(rows, states)
    report = _report(conversations, every, chains, summary, tags, states, rows, top, warned, config)
    return Run(turns, conversations, found, event, signal, summary, every, chains, buckets, tags, axes, states, rows, top, report)


def _report(conversations, every, chains, summary, tags, states, rows, top, warned, config: Config) -> DataFrame:
    counts = every.groupBy("conv_id").agg(F.count("*").alias("events"), F.max("sev_rank").alias("worst"), F.min("turn_idx").alias("min_event_turn"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.array_sort(F.collect_list(F.struct("event_id", "axis", "severity", "turn_id", "turn_idx", "source", "rule_id", "summary"))).alias("event_map"))
    repeats = chains.groupBy("conv_id").agg(F.count_if(F.col("status") == "ESCALATED").alias("escalated"))
    pieces = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "axis", "turn_id", "summary"))).alias("evidence_list"))
    joined = conversations.join(counts, "conv_id", "left").join(repeats, "conv_id", "left").join(pieces, "conv_id", "left")
    joined = joined.fillna(0, ["events", "worst", "critical", "high", "escalated"]).join(summary.select("conv_id", F.col("status").alias("vcd_status"), F.col("level").alias("vcd_level")), "conv_id").join(tags.select("conv_id", "final_level"), "conv_id").join(states, "conv_id").join(top, "conv_id")
    none = F.array().cast("array<struct<stage:string,id:string,message:string>>")
    if warned is not None:
        text = F.concat(F.lit("type "), "type", F.lit(f": more than {config.most_per_type} in a turn; the others were left"))
        own = warned.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.lit("deid").alias("stage"), F.col("finding").alias("id"), text.alias("message")))).alias("warnings"))
        joined = joined.join(own, "conv_id", "left")
    warnings = F.coalesce("warnings", none) if warned is not None else none
    incidents = F.col("vcd_status").isin("TRIGGERED", "LOCKDOWN").cast("int") + F.col("escalated")
    # the run's own trace is never empty; lint and build aren't known to a run and pass by default
    joined = joined.withColumns({"f": F.col("f_triggered"), "trace_size": F.lit(1)}).withColumn("schema_findings", F.size(gate.schema_findings())).withColumn("tests", F.when(F.col("schema_findings") > 0, "fail").otherwise("pass")).withColumn("lint", F.lit("pass")).withColumn("build", F.lit("pass"))
    joined = joined.withColumn("critical_open", F.col("critical")).withColumn("high_open", F.col("high")).withColumn("regression_failures", (F.col("schema_findings") > 0).cast("int")).withColumn("open_incidents", incidents)
    gated = gate.gate(joined, **config.gate)
    blocking = F.col("schema_findings") + F.size("gate_findings")
    by_severity = F.when(F.col("worst") == 4, "Alert").when(F.col("worst") == 3, "Deviate").when(F.col("events") > 0, "Observe").otherwise("Normal")
    by_state = lookup({"ST_ALM": "Alert", "ST_DEV": "Deviate"}, F.col("ps"), "Normal")
    by_tag = lookup({"HIGH": "Alert", "MEDIUM": "Observe"}, F.col("final_level"), "Normal")
    by_signal = lookup({"LOCKDOWN": "Alert", "TRIGGERED": "Deviate", "GUARDED": "Observe"}, F.col("vcd_status"), "Normal")
    risk = max_status(by_state, by_tag, by_signal, by_severity)
    gated = gated.withColumn("blocking_findings", blocking).withColumn("_risk", risk)
    gated = gated.withColumn("risk_status", F.when((F.col("_risk") == "Normal") & ((F.col("events") > 0) | (F.col("overall") > 0)), "Observe").otherwise(F.col("_risk")))
    gated = gated.withColumn("peak_status", max_status(F.col("risk_status"), by_severity, F.when(F.col("escalated") > 0, "Deviate").otherwise("Normal")))
    raw = 100 - F.col("events") / F.greatest(F.lit(1), F.col("turn_count")) * 32 - 7 * F.col("high") - 12 * F.col("critical") - 10 * F.col("escalated") - 8 * F.col("blocking_findings")
    index = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5)))
    margin = F.when(F.col("events") > 0, F.greatest(F.lit(0.25), F.least(F.lit(1.0), 1 / F.sqrt(F.col("events"))))).otherwise(F.lit(0.25))
    gated = gated.withColumn("stability_index", F.when(F.col("risk_status") == "Alert", F.least(index, F.lit(69))).otherwise(index).cast("int")).withColumn("_margin", margin)
    report = gated.select(
        "conv_id", F.when((F.col("gate_decision") == "GO") & (F.col("blocking_findings") == 0), "GO").otherwise("NO_GO").alias("decision"), "risk_status", "peak_status", "stability_index",
        F.coalesce("evidence_list", F.array().cast("array<struct<place:int,axis:string,turn_id:string,summary:string>>")).alias("evidence_list"), warnings.alias("false_positive_warnings"), F.col("gate_findings"), F.lit(REVIEW_NOTE).alias("human_review_note"),
        F.coalesce(F.map_from_entries(F.transform("event_map", lambda x: F.struct(x["event_id"], x))), F.create_map().cast("map<string,struct<event_id:string,axis:string,severity:string,turn_id:string,turn_idx:int,source:string,rule_id:string,summary:string>>")).alias("event_evidence_map"),
        F.round(F.greatest(F.lit(0.0), F.col("overall") - F.col("_margin")), 2).alias("ci_lower"), F.round(F.least(F.lit(4.0), F.col("overall") + F.col("_margin")), 2).alias("ci_upper"), F.lit("risk_score_0_to_4").alias("ci_unit"),
        F.struct(F.lit(SCHEMA_VERSION).alias("schema"), F.lit(len(config.event_rules or EVENT_RULES)).alias("event_rules"), F.lit(len(config.signal_rules or SIGNAL_RULES)).alias("signal_rules")).alias("rule_version"),
        "turn_count", F.col("events").alias("event_count"), "blocking_findings", "vcd_status", F.col("final_level").alias("tag_level"), "ps", "sub", "f_triggered", "e",
    )
    content = F.struct(*(c for c in report.columns if c != "event_evidence_map"))
    return report.withColumn("digital_fingerprint", F.sha2(F.to_json(content), 256))


def report_fields(report: DataFrame) -> DataFrame:
    """conv_id and the fields that gate.report_errors() reads."""
    version = F.col("rule_version")
    return report.select(
        "conv_id", F.lit(True).alias("is_object"), "risk_status", "peak_status", "stability_index", "ci_lower", "ci_upper", "ci_unit", F.when(F.col("evidence_list").isNotNull(), F.size("evidence_list")).alias("evidence_count"),
        F.when(F.col("false_positive_warnings").isNotNull(), F.size("false_positive_warnings")).alias("warning_count"), F.col("human_review_note").alias("review_note"), F.col("digital_fingerprint").alias("fingerprint"),
        version["schema"].alias("schema_version"), version["event_rules"].alias("event_rules"), version["signal_rules"].alias("signal_rules"), F.when(F.col("event_evidence_map").isNotNull(), F.size("event_evidence_map")).alias("map_size"),
    )


def report_checks(report: DataFrame) -> DataFrame:
    """conv_id and the report's consistency errors."""
    return report_fields(report).select("conv_id", gate.report_errors().alias("errors"))


def batch_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("processed"), F.count_if(F.col("decision") == "GO").alias("go"), F.count_if(F.col("decision") == "NO_GO").alias("no_go"))


def until_no_go(report: DataFrame, order_col: str = "conv_id") -> DataFrame:
    """Rows up to and with the first NO_GO in order_col's order: a minimum and a filter, not a running sum in one task."""
    first = report.where("decision = 'NO_GO'").agg(F.min(order_col).alias("_first"))
    return report.join(F.broadcast(first), on=F.coalesce(F.col(order_col) <= F.col("_first"), F.lit(True)), how="inner").drop("_first")


def resumed(cases: DataFrame, earlier: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(earlier results of these cases, cases still to run)."""
    return earlier.join(cases.select(key), key, "left_semi"), cases.join(earlier.select(key), key, "left_anti")


def configured(changes: dict, base: Config = Config()) -> Config:
    """base with changes; nested maps (gate) are merged key by key. Unknown names raise."""
    names = {f.name for f in fields(Config)}
    if unknown := sorted(set(changes) - names):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(base, **{k: merged(getattr(base, k), v) for k, v in changes.items()})


def merged(base, changes):
    """changes over base: maps key by key at every level, anything else as a whole."""
    if isinstance(base, dict) and isinstance(changes, dict):
        return base | {k: merged(base.get(k), v) for k, v in changes.items()}
    return changes


__all__ = ["Config", "Run", "batch_summary", "configured", "report_checks", "report_fields", "resumed", "run", "until_no_go"]
