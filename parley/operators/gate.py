"""Checks: output schema, invariants, release gate, report consistency. Findings are arrays of ids; a row passes if its array is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES, SIGNAL_STATES = ("ST_NRM", "ST_DEV", "ST_ALM"), ("CLEAR", "GUARDED", "TRIGGERED", "LOCKDOWN", "DISABLED")
SUBS = ("SUB_NONE", "SUB_FR", "SUB_CA", "SUB_SR", "SUB_SA", "SUB_SAFE_MODE")
EVIDENCE_MOST = 320
REQUIRED_CHECKS = ("tests", "lint", "build")


def findings(*checks: tuple[str, F.Column]) -> F.Column:
    """Ids of the checks whose condition (something is wrong) holds; null counts as not wrong."""
    return F.array_compact(F.array(*(F.when(wrong, F.lit(name)) for name, wrong in checks)))


def schema_findings() -> F.Column:
    """Of columns ps, sub, f, e, vcd_status, trace_size, min_event_turn."""
    missing = [(f"schema-required-missing:{c}", F.col(c).isNull()) for c in ("ps", "sub", "f", "e", "vcd_status")]
    return findings(
        *missing,
        ("schema-ps-invalid", ~F.col("ps").isin(*STATES)),
        ("schema-sub-invalid", ~F.col("sub").isin(*SUBS)),
        ("schema-evidence-too-long", F.length("e") > EVIDENCE_MOST),
        ("schema-vcd-status-invalid", ~F.upper("vcd_status").isin(*SIGNAL_STATES)),
        ("schema-event-turn-invalid", F.col("min_event_turn") < 0),
        ("inv-alarm-requires-flag", (F.col("ps") == "ST_ALM") & ~F.coalesce(F.col("f"), F.lit(False))),
        ("inv-normal-safe-sub", (F.col("ps") == "ST_NRM") & ~F.col("sub").isin("SUB_NONE", "SUB_SAFE_MODE")),
        ("inv-vcd-triggered-trace", (F.upper("vcd_status") == "TRIGGERED") & (F.coalesce(F.col("trace_size"), F.lit(0)) == 0)),
    )


def event_log_findings(rows: DataFrame, case_col: str = "case_id", place_col: str = "place") -> DataFrame:
    """rows (case, place, event_id, axis, severity, turn_index) with findings: faults of the row, and a turn below that of the last row before it with a valid one."""
    from ..rules import AXES, SEVERITY_RANK

    turn = F.col("turn_index")
    valid = F.coalesce(turn >= 0, F.lit(False))
    before = Window.partitionBy(case_col).orderBy(place_col).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_last", F.last(F.when(valid, turn), ignorenulls=True).over(before))
    found = findings(
        ("event-id-missing", F.btrim(F.coalesce(F.col("event_id").cast("string"), F.lit(""))) == ""),
        ("event-axis-invalid", ~F.coalesce(F.col("axis"), F.lit("")).isin(*AXES)),
        ("event-severity-invalid", ~F.coalesce(F.col("severity"), F.lit("")).isin(*SEVERITY_RANK)),
        ("event-turn-index-invalid", ~valid),
        ("event-turn-order-violation", valid & (turn < F.col("_last"))),
    )
    return marked.withColumn("findings", found).drop("_last")


def exit_code(decision) -> F.Column:
    """0 for GO, 1 for NO_GO, 2 for anything else."""
    return F.when(decision == "GO", 0).when(decision == "NO_GO", 1).otherwise(2)


def metric(x) -> F.Column:
    """A count given as text or number: blank and null are 0, anything but a whole number from 0 is null."""
    text = F.btrim(x.cast("string"))
    number = text.try_cast("double")
    return F.when(x.isNull() | (text == ""), F.lit(0)).when((number >= 0) & (number == F.floor(number)) & (number < 1e15), number.cast("long"))


def check_passed(status) -> F.Column:
    """true, pass, passed, ok, success, green; null for a missing status."""
    return F.lower(F.btrim(status)).isin("true", "pass", "passed", "ok", "success", "green")


def gate_findings(maxima: dict[str, int] | None = None, near: float | None = None, min_approvals: int = 0, need_ready: bool = False) -> F.Column:
    """Blocking findings of the release gate, of columns tests, lint, build, critical_open, high_open, regression_failures,
    open_incidents, approvals, readiness, frozen, exception_approved, exception_ticket, exception_expires (ISO), evaluated_at, rollback_plan, rollback_owner."""
    limits = {"critical_open": 0, "high_open": 0, "regression_failures": 0, "open_incidents": 0} | (maxima or {})
    parsed = {k: metric(F.col(k)) for k in limits}
    frozen = F.coalesce(F.col("frozen"), F.lit(False))
    blank = lambda c: F.btrim(F.coalesce(F.col(c), F.lit(""))) == ""
    expires, now = F.try_to_timestamp("exception_expires"), F.try_to_timestamp("evaluated_at")
    return findings(
        *((f"check-{c}-missing", F.col(c).isNull()) for c in REQUIRED_CHECKS),
        *((f"check-{c}-failed", ~check_passed(F.col(c))) for c in REQUIRED_CHECKS),
        *((f"metric-{k.replace('_', '-')}-invalid", v.isNull()) for k, v in parsed.items()),
        *((f"metric-{k.replace('_', '-')}", v > limits[k]) for k, v in parsed.items()),
        ("approvals-minimum", F.coalesce(F.col("approvals"), F.lit(0)) < min_approvals),
        *([("validation-not-ready", ~F.coalesce(F.col("readiness") == "ready", F.lit(False)))] if need_ready else []),
        ("freeze-no-exception", frozen & ~F.coalesce(F.col("exception_approved"), F.lit(False))),
        ("freeze-ticket-missing", frozen & F.col("exception_approved") & blank("exception_ticket")),
        ("freeze-expiry-missing", frozen & F.col("exception_approved") & blank("exception_expires")),
        ("freeze-expiry-invalid", frozen & F.col("exception_approved") & ~blank("exception_expires") & expires.isNull()),
        ("freeze-expired", frozen & F.col("exception_approved") & (expires <= now)),
        ("freeze-rollback-missing", frozen & ~F.coalesce(F.col("rollback_plan"), F.lit(False))),
        ("freeze-rollback-owner-missing", frozen & F.col("rollback_plan") & blank("rollback_owner")),
        *([(f"near-{k.replace('_', '-')}", (limits[k] > 0) & (v <= limits[k]) & (v >= near * limits[k])) for k, v in parsed.items()] if near else []),
    )


def gate(rows: DataFrame, **options) -> DataFrame:
    """rows with gate_findings and gate_decision. Columns that rows lacks count as null."""
    kinds = {"approvals": "int", "frozen": "boolean", "exception_approved": "boolean", "rollback_plan": "boolean"}
    columns = ["tests", "lint", "build", "critical_open", "high_open", "regression_failures", "open_incidents", "approvals", "readiness", "frozen", "exception_approved", "exception_ticket", "exception_expires", "evaluated_at", "rollback_plan", "rollback_owner"]
    lacking = {c: F.lit(None).cast(kinds.get(c, "string")) for c in columns if c not in rows.columns}
    found = rows.withColumns(lacking).withColumn("gate_findings", gate_findings(**options)).drop(*lacking)
    return found.withColumn("gate_decision", F.when(F.size("gate_findings") == 0, "GO").otherwise("NO_GO"))


def report_errors() -> F.Column:
    """Of a report's fields risk_status, peak_status, stability_index, ci_lower, ci_upper, ci_unit, evidence_count and warning_count (null: no
    array), review_note, fingerprint, schema_version, event_rules, signal_rules, map_size (null: no object): ids of the rules that it breaks. A report
    that is no object is named by `report-not-object` alone (is_object)."""
    from ..rules import REPORT_RANK, REVIEWERS, lookup

    rank = lambda c: lookup(REPORT_RANK, F.col(c), None)
    known = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c: known(F.col(c) >= 0)
    rules = findings(
        ("peak-below-risk", rank("peak_status") < rank("risk_status")),
        ("stability-range", ~known(F.col("stability_index").between(0, 100))),
        ("risk-status-invalid", rank("risk_status").isNull()),
        ("peak-status-invalid", rank("peak_status").isNull()),
        ("interval-order", ~known(F.col("ci_lower") <= F.col("ci_upper"))),
        ("interval-lower", ~known(F.col("ci_lower") >= 0)),
        ("interval-upper", ~known(F.col("ci_upper") <= 4)),
        ("interval-unit", ~known(F.col("ci_unit") == "risk_score_0_to_4")),
        ("evidence-list", F.col("evidence_count").isNull()),
        ("warning-list", F.col("warning_count").isNull()),
        ("review-note", ~known(F.contains("review_note", F.lit(REVIEWERS)))),
        ("fingerprint-format", ~known(F.col("fingerprint").rlike("^[a-f0-9]{64}$"))),
        ("rule-version", ~(known(F.btrim("schema_version") != "") & count("event_rules") & count("signal_rules"))),
        ("evidence-map", F.col("map_size").isNull()),
        ("normal-much-evidence", (F.col("risk_status") == "Normal") & (F.col("evidence_count") > 1)),
        ("alert-stability", (F.col("risk_status") == "Alert") & (F.col("stability_index") >= 70)),
        ("normal-with-evidence", (F.col("risk_status") == "Normal") & (F.col("evidence_count") > 0)),
        ("evidence-map-size", F.col("evidence_count") != F.col("map_size")),
    )
    return F.when(known(F.col("is_object")), rules).otherwise(F.array(F.lit("report-not-object")))
