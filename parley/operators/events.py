"""Risk events and signals: phrase rules over turns, the context-drift heuristic, trust and boundary signals.

Rules are an array literal that each turn filters, so no join and no row for a rule that doesn't hit; only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import centred_excerpt, content_words, excerpt, has_distress_cue, let
from ..rules import AXIS_OF_FAMILY, BOUNDARY_SCORE, CAP, EVENT_RULES, EXCERPT, SEVERITY_RANK, SIGNAL_ACTIONS, SIGNAL_EXCERPT, SIGNAL_RULES, SIGNAL_THRESHOLDS, TRUST_SCORE, lookup, rule_array, select_rules

EVENT_DEFAULT = [(i, axis, severity, "any", phrases) for i, axis, severity, phrases in EVENT_RULES]
DRIFT_RULE = "CA_01"


def rule_hits(turns: DataFrame, rules: list[tuple]) -> DataFrame:
    """One row per turn and rule that hits: turns' columns, ord, rule_id, grp, severity, matched (phrases), first_idx (from 0)."""

    def hits(low):
        def with_matches(r):
            return F.struct(*(r[k].alias(k) for k in ("ord", "rule_id", "grp", "severity", "mode")), F.size(r["phrases"]).alias("n"), F.filter(r["phrases"], lambda p: F.contains(low, F.lower(p))).alias("matched"))

        found = F.filter(F.transform(rule_array(rules), with_matches), lambda r: F.when(r["mode"] == "all", F.size(r["matched"]) == r["n"]).otherwise(F.size(r["matched"]) > 0))
        return F.transform(found, lambda r: F.struct(*(r[k].alias(k) for k in ("ord", "rule_id", "grp", "severity", "matched")), (F.array_min(F.transform(r["matched"], lambda p: F.position(F.lower(p), low))) - 1).alias("first_idx")))

    if not rules:
        rules = [("", "", "low", "all", [""])]
        turns = turns.where(F.lit(False))
    return turns.withColumn("_hit", F.explode(let(F.lower("text"), hits))).select(*turns.columns, "_hit.*")


def context_drift(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_idx) of assistant turns whose content shares nothing with all before, after a user's sign of distress.

    An earlier occurrence of a word is its first one, so no turn is joined with those before it: linear in words. Words are taken only
    of conversations in which a user shows distress before some answer."""
    distress = (F.col("role") == "user") & has_distress_cue(F.col("text"))
    spans = turns.groupBy("conv_id").agg(F.min(F.when(distress, F.col("turn_idx"))).alias("first"), F.max(F.when(F.col("role") == "assistant", F.col("turn_idx"))).alias("last"))
    turns = turns.join(spans.where("first < last").select("conv_id"), "conv_id", "left_semi")
    words = turns.select("conv_id", "turn_idx", F.explode(content_words(F.col("text"))).alias("word"))
    first = F.min("turn_idx").over(Window.partitionBy("conv_id", "word"))
    per_turn = words.withColumn("first", first).groupBy("conv_id", "turn_idx").agg(F.count("*").alias("n"), F.sum((F.col("first") < F.col("turn_idx")).cast("int")).alias("old"), F.sum((F.col("first") == F.col("turn_idx")).cast("int")).alias("new"))
    cues = turns.select("conv_id", "turn_idx", "role", ((F.col("role") == "user") & has_distress_cue(F.col("text"))).alias("cue")).join(per_turn, ["conv_id", "turn_idx"], "left")
    before = Window.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = cues.withColumn("distress", F.max("cue").over(before)).withColumn("vocabulary", F.sum(F.coalesce("new", F.lit(0))).over(before))
    return seen.where((F.col("role") == "assistant") & F.col("distress") & (F.col("n") >= 3) & (F.col("vocabulary") >= 4) & (F.col("old") == 0)).select("conv_id", "turn_idx")


def risk_events(turns: DataFrame, rules: list[tuple] | None = None, cap: int = CAP, excerpt_length: int = EXCERPT, drift: bool = True) -> DataFrame:
    """conv_id, turn_idx, turn_id, ord, rule_id, axis, severity, matched, excerpt, hit_no, event_id: at most cap events of a rule in a conversation."""
    rules = EVENT_DEFAULT if rules is None else rules
    hits = rule_hits(turns, rules).select("conv_id", "turn_idx", "turn_id", "ord", "rule_id", F.col("grp").alias("axis"), "severity", "matched", excerpt(F.col("text"), F.col("first_idx"), excerpt_length).alias("excerpt"))
    own = next((r for r in rules if r[0] == DRIFT_RULE), None)
    if drift and own:
        drifted = turns.join(context_drift(turns), ["conv_id", "turn_idx"], "left_semi").join(hits.where(F.col("rule_id") == DRIFT_RULE), ["conv_id", "turn_idx"], "left_anti")
        hits = hits.unionByName(drifted.select("conv_id", "turn_idx", "turn_id", F.lit(len(rules) + 1).alias("ord"), F.lit(own[0]).alias("rule_id"), F.lit(own[1]).alias("axis"), F.lit(own[2]).alias("severity"), F.array(F.lit("context drift")).alias("matched"), excerpt(F.col("text"), F.lit(0), excerpt_length).alias("excerpt")))
    order = Window.partitionBy("conv_id", "rule_id").orderBy("turn_idx", "ord")
    numbered = hits.withColumn("hit_no", F.row_number().over(order)).where(F.col("hit_no") <= cap)
    return numbered.withColumn("event_id", F.concat("rule_id", F.lit("@"), "turn_id", F.lit("#"), F.col("hit_no").cast("string")))


def signals(turns: DataFrame, rules: list[tuple] | None = None, cap: int = CAP, excerpt_length: int = SIGNAL_EXCERPT) -> DataFrame:
    """conv_id, turn_idx, turn_id, emit_ord, source (matrix, trust, boundary), rule_id, family, severity, score, matched, excerpt, event_id."""
    rules = SIGNAL_RULES if rules is None else rules
    text = F.col("text")
    columns = ["conv_id", "turn_idx", "turn_id"]
    matrix = rule_hits(turns, rules).select(*columns, F.col("ord").alias("emit_ord"), F.lit("matrix").alias("source"), "rule_id", F.col("grp").alias("family"), "severity", lookup(SEVERITY_RANK, F.col("severity"), 0).alias("score"), "matched", centred_excerpt(text, F.lower(F.element_at("matched", 1)), excerpt_length).alias("excerpt"))
    prefix, none = centred_excerpt(text, F.lit(""), excerpt_length).alias("excerpt"), F.array().cast("array<string>").alias("matched")
    trust = turns.where(F.col("source_trust").isin("unknown", "untrusted")).select(*columns, F.lit(len(rules) + 1).alias("emit_ord"), F.lit("trust").alias("source"), F.lit("VCDE_TRUST").alias("rule_id"), F.lit("source_confidence").alias("family"), F.when(F.col("source_trust") == "untrusted", "high").otherwise("medium").alias("severity"), lookup(TRUST_SCORE, F.col("source_trust"), 0).alias("score"), none, prefix)
    boundary = turns.where("boundary_bypass").select(*columns, F.lit(len(rules) + 2).alias("emit_ord"), F.lit("boundary").alias("source"), F.lit("VCDE_BOUNDARY").alias("rule_id"), F.lit("boundary").alias("family"), F.lit("critical").alias("severity"), F.lit(BOUNDARY_SCORE).alias("score"), none, prefix)
    every = matrix.unionByName(trust).unionByName(boundary)
    kept = every.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "rule_id").orderBy("turn_idx"))).where(F.col("_n") <= cap).drop("_n")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_idx", "emit_ord"))
    return kept.withColumn("event_id", F.format_string("VCD-%04d", number))


def signal_status(score) -> F.Column:
    out = F.lit("CLEAR")
    for status, least in sorted(SIGNAL_THRESHOLDS.items(), key=lambda x: x[1]):
        out = F.when(score >= least, F.lit(status)).otherwise(out)
    return out


def signal_summary(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conversation: risk_score, status, level, action, trigger_count, matrix_hits, trust_signals, boundary_signals."""
    own = found.groupBy("conv_id").agg(F.sum("score").alias("risk_score"), F.count("*").alias("trigger_count"), *(F.count_if(F.col("source") == s).alias(n) for s, n in (("matrix", "matrix_hits"), ("trust", "trust_signals"), ("boundary", "boundary_signals"))))
    whole = conversations.select("conv_id").join(own, "conv_id", "left").fillna(0)
    status = signal_status(F.col("risk_score"))
    return whole.withColumn("status", status).withColumn("level", F.concat(F.lit("VCD_"), "status")).withColumn("action", lookup(SIGNAL_ACTIONS, F.col("status")))


def unified(events: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, src_ord, ord, event_id, source, axis, severity, sev_rank, turn_idx, turn_id, rule_id, summary of both kinds."""
    summary = F.coalesce(F.nullif(F.btrim("excerpt"), F.lit("")), F.concat("rule_id", F.lit(" triggered.")))
    rank = lookup(SEVERITY_RANK, F.col("severity"), 0).alias("sev_rank")
    first = events.select("conv_id", F.lit(0).alias("src_ord"), "ord", "event_id", F.lit("event-engine").alias("source"), "axis", "severity", rank, "turn_idx", "turn_id", "rule_id", summary.alias("summary"))
    second = found.select("conv_id", F.lit(1).alias("src_ord"), F.col("emit_ord").alias("ord"), "event_id", F.lit("vcd").alias("source"), lookup(AXIS_OF_FAMILY, F.col("family"), "CA").alias("axis"), "severity", rank, "turn_idx", "turn_id", "rule_id", summary.alias("summary"))
    return first.unionByName(second)


__all__ = ["context_drift", "risk_events", "rule_hits", "select_rules", "signal_status", "signal_summary", "signals", "unified"]
