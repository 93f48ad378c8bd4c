"""Ground truth grown from pools of conversations: a quota of each source, analysed once; manifest, items of two raters, agreement and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import agreement, annotations
from ..rules import EVENT_RULES, REPORT_RANK, SIGNAL_RULES
from ..storage import saved
from . import risk


def chosen(cases: DataFrame, targets: dict[str, int], group_col: str | None = None) -> DataFrame:
    """cases (case_id, family, ...): each family's target of cases, by round robin over group_col's groups if given, else by case_id."""
    rows = cases.where(F.col("family").isin(*targets))
    if group_col:
        rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("family", group_col).orderBy("case_id")))
    order = [F.col("_turn"), F.col(group_col), F.col("case_id")] if group_col else [F.col("case_id")]
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy("family").orderBy(*order)))
    quota = F.lit(0)
    for name, n in targets.items():
        quota = F.when(F.col("family") == name, n).otherwise(quota)
    return placed.where(F.col("_place") <= quota).drop("_place", "_turn")


def expand(cases: DataFrame, turns: DataFrame, config: risk.Config = risk.Config()) -> dict[str, DataFrame]:
    """cases: case_id, family; turns: operators.turns columns, conv_id being the case. -> manifest (a row for each case: decision, risk_status, peak_status, event_rules,
    signal_rules), items (annotations.event_items of two raters), irr (agreement.batch_irr) and summary (one row)."""
    run = risk.run(turns.join(cases.select(F.col("case_id").alias("conv_id")), "conv_id", "left_semi"), config)
    rules = lambda found, name: found.groupBy("conv_id").agg(F.array_sort(F.collect_set("rule_id")).alias(name))
    none = F.array().cast("array<string>")
    joined = run.report.select("conv_id", "decision", "risk_status", "peak_status").join(rules(run.events, "event_rules"), "conv_id", "left").join(rules(run.signals.where("source = 'matrix'"), "signal_rules"), "conv_id", "left")
    manifest = saved(cases.select("case_id", "family").join(joined.withColumnRenamed("conv_id", "case_id"), "case_id").withColumns({c: F.coalesce(c, none) for c in ("event_rules", "signal_rules")}), "manifest")
    items = annotations.event_items(run.events, run.signals)
    ratings = items.select("conv_id", "turn_id", F.when(F.col("rater") == "rater_A", "a").otherwise("b").alias("rater"), "severity")
    irr = agreement.batch_irr(agreement.severity_units(run.turns, ratings))
    return {"manifest": manifest, "items": items, "irr": irr, "summary": summary(manifest, irr)}


def summary(manifest: DataFrame, irr: DataFrame, least_cases: int = 200, least_kappa: float = 0.61) -> DataFrame:
    """One row: total, sources and risk levels (maps), rules covered and rules that aren't in the catalogues, and whether the bars are met."""
    known = {"event_rules": {r[0] for r in EVENT_RULES}, "signal_rules": {r[0] for r in SIGNAL_RULES}}
    count = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count"))))
    sources = manifest.groupBy("family").count().agg(count("family").alias("sources"))
    risks = manifest.groupBy("risk_status").count().agg(count("risk_status").alias("risks"))
    seen = manifest.agg(F.count("*").alias("total"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in known))  # sets of rule ids: as many as the catalogues allow
    row = seen.crossJoin(F.broadcast(sources)).crossJoin(F.broadcast(risks)).crossJoin(F.broadcast(irr.select("kappa")))  # one row each
    for c, ids in known.items():
        every = F.array(*map(F.lit, sorted(ids)))
        row = row.withColumns({f"{c}_covered": F.size(F.array_intersect(c, every)), f"{c}_unknown": F.array_except(c, every)})
    return row.select(
        "total", "sources", "risks", "event_rules_covered", "signal_rules_covered", "event_rules_unknown", "signal_rules_unknown", "kappa", (F.col("total") >= least_cases).alias("enough_cases"),
        (F.col("event_rules_covered") == len(known["event_rules"])).alias("all_event_rules"), (F.col("signal_rules_covered") == len(known["signal_rules"])).alias("all_signal_rules"),
        (F.size("risks") == len(REPORT_RANK)).alias("all_risk_levels"), (F.coalesce("kappa", F.lit(0.0)) >= least_kappa).alias("kappa_reached"),
    )
