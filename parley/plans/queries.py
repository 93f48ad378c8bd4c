"""The registered queries: name -> function of (spark, folder). Each returns flat columns; `oracle.py` has the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import text as tx
from ..operators import agreement, annotations, deid, events, filtering, gate, ledger, profile, regression, sampling, scores, turns, validation
from ..rules import EVENT_RULES, SIGNAL_RULES
from ..sources import corpus, sinks, synthetic, transcripts
from . import datasets, ground_truth, risk
from .risk import Config

#: What the analysis queries add to every fourth turn, since the tables hold no rule's phrase.
PHRASES = [p for *_, ps in EVENT_RULES for p in ps] + [p for *_, ps in SIGNAL_RULES for p in ps] + ["official source, trust me", "so worried and scared", "crash loop and network outage"]
#: Custom rules over words of the tables.
WORD_RULES = [("W_01", "CA", "low", "any", ["the", "der"]), ("W_02", "SR", "high", "all", ["of", "that"]), ("W_03", "FR", "medium", "any", ["ening", "ung "]), ("W_04", "SA", "critical", "all", ["and", "in", "thor"])]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_turns(spark, sf_dir) -> DataFrame:
    return turns.from_rows(table(spark, sf_dir, "conversations"))


def injected(spark, sf_dir) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn_idx")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((c * 31 + t * 7) % len(PHRASES) + 1).cast("int"))
    return plain_turns(spark, sf_dir).withColumn("text", F.when((c * 13 + t * 5) % 4 == 0, F.concat("text", F.lit(" "), phrase)).otherwise(F.col("text"))).withColumn("boundary_bypass", (c * 17 + t) % 29 == 0)


def injected_run(spark, sf_dir) -> risk.Run:
    return risk.run(injected(spark, sf_dir), Config(deidentify=False))


def with_personal_data(spark, sf_dir) -> DataFrame:
    """The injected turns, every fifth of which names an address and a host."""
    named = (F.col("conv_id") * 7 + F.col("turn_idx")) % 5 == 0
    return injected(spark, sf_dir).withColumn("text", F.when(named, F.concat("text", F.lit(" mail a.b1@example.org from 10.20.30.4"))).otherwise(F.col("text")))


# --- turns, rules, events, signals


@query
def turns_normalized(spark, sf_dir):
    return plain_turns(spark, sf_dir).select("conv_id", "turn_idx", "turn_id", "role", "source_trust", F.length("text").alias("n_chars"))


@query
def event_hits_by_rule(spark, sf_dir):
    return events.risk_events(injected(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("n"), F.max("hit_no").cast("int").alias("most_in_conversation"))


@query
def event_axis_severity_grouping_sets(spark, sf_dir):
    found = events.risk_events(injected(spark, sf_dir))
    return found.groupingSets([["axis"], ["severity"], ["axis", "severity"], []], "axis", "severity").agg(F.count("*").alias("n"))


@query
def event_excerpts(spark, sf_dir):
    return events.risk_events(injected(spark, sf_dir)).select("conv_id", "event_id", "axis", "severity", F.array_join("matched", ";").alias("matched"), "excerpt")


@query
def context_drift_hits(spark, sf_dir):
    """With a sign of distress in the first turns and, in some answers, words of their own."""
    c, t = F.col("conv_id"), F.col("turn_idx")
    own = F.concat(F.lit("zebra quilt mango lantern"), (c % 3).cast("string"))
    text = F.when((F.col("role") == "assistant") & ((c + t) % 3 == 0), own).when(t == 0, F.concat("text", F.lit(" I am so WORRIED"))).otherwise(F.col("text"))
    return events.context_drift(plain_turns(spark, sf_dir).withColumn("text", text))


@query
def rule_hits_custom_words(spark, sf_dir):
    return events.rule_hits(plain_turns(spark, sf_dir), WORD_RULES).groupBy("rule_id", "grp").agg(F.count("*").alias("n"), F.sum("first_idx").alias("first_places"), F.sum(F.size("matched")).alias("phrases"))


@query
def rule_selection(spark, sf_dir):
    rules = events.select_rules(events.EVENT_DEFAULT, disabled=["SR_01", "FR_01"], min_severity="high")
    return events.risk_events(injected(spark, sf_dir), rules, drift=False).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query
def vcd_events_numbered(spark, sf_dir):
    return events.signals(injected(spark, sf_dir)).select("conv_id", "event_id", "source", "rule_id", "family", "severity", "turn_id", "excerpt")


@query
def vcd_status(spark, sf_dir):
    source = plain_turns(spark, sf_dir)
    return events.signal_summary(events.signals(source), source.select("conv_id").distinct()).select("conv_id", "risk_score", "trust_signals", "status", "level", "action")


@query
def vcd_status_counts(spark, sf_dir):
    source = injected(spark, sf_dir)
    return events.signal_summary(events.signals(source), source.select("conv_id").distinct()).groupBy("status").agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk_score"), F.sum("matrix_hits").alias("matrix_hits"), F.sum("boundary_signals").alias("boundary_signals"))


@query
def unified_events(spark, sf_dir):
    return injected_run(spark, sf_dir).unified.select("conv_id", "source", "event_id", "axis", "severity", "turn_idx", "rule_id")


# --- ledger


def ledger_input(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("int")
    return e.select(F.col("user_id").alias("conv_id"), F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 3 == 0, "fact").otherwise("context").alias("ledger_type"), F.col("event_type").alias("entry_key"), turn.alias("turn_idx"), F.col("event_id").alias("ord_key"), (F.col("event_type").isin("error", "purchase") & (F.col("event_id") % 7 == 0)).alias("resolved"))


@query
def ledger_decisions(spark, sf_dir):
    return ledger.repeat_chains(ledger_input(spark, sf_dir)).select("conv_id", "event_id", "ledger_type", "entry_key", "turn_idx", "repeat_count", "status")


@query
def ledger_summary(spark, sf_dir):
    return ledger.ledger_summary(ledger.repeat_chains(ledger_input(spark, sf_dir)))


@query
def ledger_cross_key_rejects(spark, sf_dir):
    return ledger.cross_ledger_rejects(ledger_input(spark, sf_dir)).groupBy("conv_id", "entry_key").agg(F.count_if("rejected").alias("rejected"), F.count("*").alias("n"))


@query
def ledger_input_errors(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.when(n % 11 == 0, "other").otherwise("fact").alias("ledger_type"), F.when(n % 13 == 0, "  ").otherwise(F.col("event_type")).alias("entry_key"), F.when(n % 17 == 0, -1).otherwise(n % 100).alias("turn_idx"),
        F.when(n % 19 == 0, (n % 100) + 1).otherwise(n % 100).alias("range_start"), F.when(n % 23 == 0, (n % 100) + 90).otherwise(n % 100 + 1).alias("range_end"),
    )
    return rows.select(F.coalesce(ledger.event_errors(), F.lit("none")).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


# --- levels, scores, state, report


@query
def tag_buckets(spark, sf_dir):
    return injected_run(spark, sf_dir).buckets.select("conv_id", "tag_axis", "severity", "n", F.col("weighted").cast("double").alias("weighted"))


@query
def tag_level(spark, sf_dir):
    return injected_run(spark, sf_dir).tags.select("conv_id", F.col("total_score").cast("double").alias("total_score"), "base_level", "final_level", "critical_events", "medium_axes")


@query
def tag_level_history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("value") > 40, "HIGH").when(F.col("value") > 15, "MEDIUM").otherwise("LOW")
    folded = scores.level_history(e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), level.alias("level")))
    return folded.select("conv_id", F.explode("rounds").alias("r")).groupBy("conv_id").agg(F.count_if(F.col("r.level") == "HIGH").alias("high"), F.count_if(F.col("r.level") == "MEDIUM").alias("medium"), F.sum("r.stable").alias("stable"))


@query
def axis_scores(spark, sf_dir):
    return injected_run(spark, sf_dir).axes


@query
def ps_sub_f(spark, sf_dir):
    return injected_run(spark, sf_dir).state.select("conv_id", "overall", "high_axes", "ps", "sub", "f_triggered", "f_level", F.array_join("f_reasons", ";").alias("f_reasons"))


@query
def evidence_topk(spark, sf_dir):
    return injected_run(spark, sf_dir).top


def report_columns(report: DataFrame, *more) -> DataFrame:
    return report.select("conv_id", "decision", "risk_status", "peak_status", "stability_index", "ci_lower", "ci_upper", "turn_count", "event_count", "blocking_findings", "vcd_status", "tag_level", "ps", "sub", F.size("evidence_list").alias("evidence_count"), F.size("event_evidence_map").alias("map_size"), *more)


@query
def risk_report(spark, sf_dir):
    return report_columns(injected_run(spark, sf_dir).report)


@query
def risk_report_deidentified(spark, sf_dir):
    """The whole run as it is by default: personal data is replaced first; the evidence's digest shows the replacements."""
    return report_columns(risk.run(with_personal_data(spark, sf_dir)).report, F.sha2("e", 256).alias("e_sha"))


@query
def gate_decisions(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.when(n % 5 == 0, "fail").when(n % 31 == 0, F.lit(None)).otherwise(" PASS ").alias("tests"), F.lit("ok").alias("lint"), F.lit("true").alias("build"),
        F.when(n % 7 == 0, "1").when(n % 41 == 0, "-2").otherwise("").alias("critical_open"), (n % 3 == 0).cast("int").cast("string").alias("high_open"), F.lit("0").alias("regression_failures"), F.lit(None).cast("string").alias("open_incidents"),
        (n % 4).cast("int").alias("approvals"), F.when(n % 2 == 0, "ready").otherwise("not_ready").alias("readiness"), (n % 6 == 0).alias("frozen"), (n % 12 == 0).alias("exception_approved"), F.when(n % 24 == 0, "T-1").otherwise("").alias("exception_ticket"),
        F.when(n % 36 == 0, "2020-01-01T00:00:00Z").when(n % 48 == 0, "someday").otherwise("2030-01-01T00:00:00Z").alias("exception_expires"), F.lit("2025-01-01T00:00:00Z").alias("evaluated_at"), (n % 18 == 0).alias("rollback_plan"), F.when(n % 54 == 0, "ops").otherwise("").alias("rollback_owner"),
    )
    return gate.gate(rows, min_approvals=1, need_ready=True, maxima={"high_open": 1}).select("case_id", "gate_decision", F.array_join("gate_findings", ";").alias("findings"))


@query
def schema_invariant_findings(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.when(n % 9 == 0, "ST_XXX").when(n % 3 == 0, "ST_ALM").when(n % 3 == 1, "ST_NRM").otherwise("ST_DEV").alias("ps"), F.when(n % 4 == 0, "SUB_NONE").when(n % 4 == 1, "SUB_SR").when(n % 28 == 2, F.lit(None)).otherwise("SUB_SAFE_MODE").alias("sub"),
        (n % 5 != 0).alias("f"), F.repeat(F.lit("e"), (n % 400).cast("int")).alias("e"), F.when(n % 2 == 0, "triggered").otherwise("CLEAR").alias("vcd_status"), (n % 10).cast("int").alias("trace_size"), (n % 8 - 1).cast("int").alias("min_event_turn"),
    )
    return rows.select("case_id", gate.schema_findings().alias("x")).select(F.explode("x").alias("finding")).groupBy("finding").agg(F.count("*").alias("n"))


@query
def report_consistency(spark, sf_dir):
    """Reports whose fields are broken by their number, so that every rule has rows; nothing of the findings is left out."""
    fields, c = risk.report_fields(injected_run(spark, sf_dir).report), F.col("conv_id")
    changes = {
        "is_object": F.when(c % 29 == 4, False), "risk_status": F.when(c % 15 == 7, "Odd"), "peak_status": F.when(c % 14 == 3, "Normal"), "stability_index": F.when(c % 4 == 0, 170), "ci_lower": F.when(c % 7 == 6, -1.0).when(c % 13 == 5, 4.5),
        "ci_upper": F.when(c % 11 == 2, 5.0), "ci_unit": F.when(c % 10 == 0, "percent"), "review_note": F.when(c % 9 == 4, "ok"), "fingerprint": F.when(c % 6 == 0, "x"), "schema_version": F.when(c % 8 == 5, " "), "event_rules": F.when(c % 12 == 7, -1),
    }
    lost = {"evidence_count": c % 17 == 1, "warning_count": c % 19 == 2, "map_size": c % 23 == 3}
    broken = fields.withColumns({k: F.coalesce(v, F.col(k)) for k, v in changes.items()} | {k: F.when(~v, F.col(k)) for k, v in lost.items()})
    return broken.select("conv_id", F.array_join(gate.report_errors(), ";").alias("errors"))


@query
def event_log_order(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), n.alias("place"), n.alias("number"), F.when(n % 31 == 0, " ").otherwise(n.cast("string")).alias("event_id"), F.when(n % 29 == 0, "XX").otherwise("FR").alias("axis"), F.when(n % 23 != 0, "low").alias("severity"),
        F.when(n % 37 == 0, -1).when(n % 41 != 0, n * 7919 % 50).alias("turn_index"),
    )
    found = gate.event_log_findings(rows).select("number", F.explode("findings").alias("finding"))
    return found.groupBy("finding").agg(F.count("*").alias("n"), F.sum("number").alias("event_sum"))


@query
def batch_summary(spark, sf_dir):
    return risk.batch_summary(injected_run(spark, sf_dir).report)


@query
def batch_stop_on_no_go(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"), F.when(n > 700, F.when(n % 13 == 0, "NO_GO").otherwise("GO")).otherwise("GO").alias("decision"))
    return risk.until_no_go(rows)


@query
def batch_resume(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"))
    earlier = cases.where(F.col("conv_id") % 3 == 0).withColumn("decision", F.lit("GO"))
    done, rest = risk.resumed(cases, earlier)
    return done.select("conv_id", F.lit("resumed").alias("state")).unionByName(rest.select("conv_id", F.lit("to_run").alias("state")))


# --- personal data and secrets


def pii_matches(spark, sf_dir, pattern: str, text=None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", text if text is not None else F.col("text"))
    found = docs.select("doc_id", F.explode(pii.matches_of(F.col("text"), pattern)).alias("m"))
    return found.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.value").alias("value"))


@query
def pii_email(spark, sf_dir):
    return pii_matches(spark, sf_dir, pii.EMAIL).groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query
def pii_ipv4(spark, sf_dir):
    return pii_matches(spark, sf_dir, pii.IPV4).groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query
def pii_card_luhn(spark, sf_dir):
    return pii_matches(spark, sf_dir, pii.CARD).where(pii.luhn_valid(F.col("value"))).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query
def pii_national_id(spark, sf_dir):
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("doc_id") % 26 + 1).cast("int"), F.lit(1))
    number = F.lpad((F.col("doc_id") * 7919 % 100_000_000).cast("string"), 8, "0")
    text = F.concat(F.lit("id "), letter, (F.col("doc_id") % 2 + 1).cast("string"), number, F.lit(" end"))
    return pii_matches(spark, sf_dir, pii.NATIONAL_ID, text).where(pii.national_id_valid(F.col("value"))).select("doc_id", "start", "value")


@query
def pii_query_secret(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" http://a.example/x?q=1&Token="), F.md5(F.col("doc_id").cast("string")), F.lit("#z"))
    return pii_matches(spark, sf_dir, pii.QUERY_SECRET, text).select("doc_id", "start", "value")


@query
def pii_counts_by_type(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn_idx"), "text")
    return deid.counts_by_type(deid.replacements(docs, ["email", "ipv4", "query_secret"])).withColumnRenamed("conv_id", "doc_id")


@query
def deid_redacted_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn_idx"), "text")
    redacted = deid.redact(docs, deid.replacements(docs, ["ipv4"]))
    return redacted.select(F.col("conv_id").alias("doc_id"), F.length("text").alias("n_chars"), F.sha2(F.regexp_replace("text", r"\[IPV4_[0-9]+\]", "<ip>"), 256).alias("sha"))


@query
def deid_replacements(spark, sf_dir):
    """All detectors over all texts; the tests hold it against a brute-force version."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn_idx"), "text")
    return deid.replacements(docs)


@query
def deid_skipped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn_idx"), F.repeat(F.lit("x1@example.org "), (F.col("doc_id") % 150).cast("int")).alias("text"))
    return deid.skipped(docs, 100, ["email"]).select(F.col("conv_id").alias("doc_id"), "type", "skipped", "finding")


@query
def secret_scan(spark, sf_dir):
    return profile.secret_findings(table(spark, sf_dir, "documents"), "doc_id").select("id", "line_no", "column_no", "pattern")


# --- filters, duplicates, samples


@query
def quality_noise_flags(spark, sf_dir):
    c = filtering.Filter()
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(filtering.noise_reason(F.col("text"), c), F.lit("none")).alias("noise"))


@query
def quality_disposition(spark, sf_dir):
    source = plain_turns(spark, sf_dir)
    languages = source.select("conv_id").distinct().withColumn("language", F.when(F.col("conv_id") % 5 == 0, "de").when(F.col("conv_id") % 7 == 0, "zh-TW").otherwise("EN-us"))
    return filtering.evaluate(source, languages).select("conv_id", "bucket", F.coalesce("reason", F.lit("none")).alias("reason"), "language", "pruned_turns")


@query
def language_detect(spark, sf_dir):
    expected, known = F.when(F.col("doc_id") % 3 == 0, "en"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.detect_language(F.col("text"), expected, known).alias("language"))


@query
def filter_report_rollup(spark, sf_dir):
    source = plain_turns(spark, sf_dir)
    languages = source.select("conv_id").distinct().withColumn("language", F.lit("en"))
    return filtering.report(filtering.evaluate(source, languages)).select(F.coalesce("bucket", F.lit("all")).alias("bucket"), F.coalesce("reason", F.when(F.col("level") == 0, "none").otherwise("all")).alias("reason"), "n", "pruned_turns")


@query
def dedupe_global_first(spark, sf_dir):
    return filtering.first_of_each(table(spark, sf_dir, "documents"), F.sha2(F.btrim("text"), 256), "doc_id")


@query
def weighted_round_robin(spark, sf_dir):
    return sampling.weighted_round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", {"src0": 3, "src1": 1, "src2": 2}, 60).select("doc_id", "sample_id", "round", "slot")


@query
def round_robin_by_group(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 50).select("doc_id", "lang", "rn")


@query
def largest_remainder_targets(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return sampling.largest_remainder_targets(counts, "lang", "n", 333)


# --- profiles


@query
def field_integrity_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 10 == 0, F.lit("  ")).otherwise(F.col("lang")))
    return profile.integrity(docs, ["doc_id", "text", "lang", "source"])


@query
def label_mapping_grouping_sets(spark, sf_dir):
    mapped = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.struct(F.lit("SR").alias("axis"), F.lit("high").alias("severity"))), F.when(F.col("quality") == 0, F.struct(F.lit("CA").alias("axis"), F.lit("low").alias("severity"))), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.struct(F.lit("SA").alias("axis"), F.lit("high").alias("severity")))))
    return profile.mapping_counts(table(spark, sf_dir, "labels"), mapped).select("axis", "severity", "n")


@query
def label_counters(spark, sf_dir):
    return profile.label_counts(table(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("lang"))), "lang")


@query
def emotion_style_unpivot_profile(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("rare", F.when(F.col("doc_id") % 4 == 0, F.col("toxic")))
    return profile.flag_profile(labels, ["quality", "toxic", "rare"], ["lang"])


@query
def cube_split_label_method(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return joined.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")).cube("split", "quality", "lang").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query
def risk_distribution_check(spark, sf_dir):
    targets = spark.createDataFrame([("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15)], "value string, target double")
    return profile.distribution_check(table(spark, sf_dir, "documents"), "lang", targets)


@query
def rule_coverage(spark, sf_dir):
    source = injected(spark, sf_dir)
    rules = spark.createDataFrame([(r[0],) for r in WORD_RULES], "rule_id string")
    hits = events.rule_hits(source, WORD_RULES).select("conv_id", "turn_idx", "rule_id", F.lit(True).alias("hit"))
    every = source.select("conv_id", "turn_idx").withColumn("rule_id", F.explode(F.array(*(F.lit(r[0]) for r in WORD_RULES)))).join(hits, ["conv_id", "turn_idx", "rule_id"], "left").fillna({"hit": False})
    return profile.coverage(every.withColumn("expected", F.col("hit")), rules)


@query
def dashboard_latest(spark, sf_dir):
    return profile.latest(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "ts", "event_id", 50).select("event_id", "event_type")


# --- agreement, regression


@query
def cohen_kappa_4(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("a"), F.when(F.col("value") > 10, F.col("event_id") % 4).otherwise(F.col("event_id") % 3).alias("b"))
    return agreement.kappa(rows, "a", "b")


@query
def cohen_kappa_labels(spark, sf_dir):
    return agreement.kappa(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), "quality", "toxic", ["lang"])


@query
def icc_2_1(spark, sf_dir):
    return agreement.icc_2_1(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", 4)


@query
def jaccard_rules(spark, sf_dir):
    found = events.rule_hits(injected(spark, sf_dir), WORD_RULES)
    sets = found.groupBy("conv_id").agg(F.array_sort(F.collect_set("rule_id")).alias("a"), F.array_sort(F.collect_set(F.when(F.col("turn_idx") % 2 == 0, F.col("rule_id")))).alias("b"))
    return agreement.rule_agreement(sets, "a", "b")


@query
def irr_weighted_batch(spark, sf_dir):
    source = plain_turns(spark, sf_dir)
    ratings = source.select("conv_id", "turn_id", F.explode(F.array(F.struct(F.lit("a").alias("rater"), (F.length("text") % 3).alias("severity")), F.struct(F.lit("b").alias("rater"), (F.length("text") % 5 % 3).alias("severity")))).alias("r")).select("conv_id", "turn_id", "r.rater", "r.severity")
    return agreement.batch_irr(agreement.severity_units(source, ratings))


@query
def axis_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a_q"), F.col("l_linenumber").alias("b_q"), (F.col("l_orderkey") % 7).alias("a_k"), (F.col("l_partkey") % 7).alias("b_k"))
    return agreement.axis_agreement(rows, ["q", "k"], 4)


@query
def descriptive_stats(spark, sf_dir):
    return agreement.descriptive(table(spark, sf_dir, "events"), "value", ["event_type"], 3)


@query
def confusion_2x2(spark, sf_dir):
    return agreement.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


def outputs(spark, sf_dir, changed: bool) -> DataFrame:
    n = F.col("o_orderkey")
    value = F.when(n % 11 == 0, '{"b": 2, "a": [1, 2]}').when(n % 11 == 1, '"same"').when(n % 11 == 2, "7").otherwise('{"a": {"y": true, "x": null}}')
    if changed:
        value = F.when(n % 11 == 0, '{"a":[1,2],"b":2}').when(n % 22 == 1, '"other"').when(n % 22 == 2, "8").when(n % 33 == 2, '"8"').when(n % 44 == 3, '{"a": {"y": false, "x": null}}').otherwise(value)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), value.alias("output"))
    return rows.where("case_id % 17 <> 0") if changed else rows.where("case_id % 19 <> 0")


@query
def regression_full_outer(spark, sf_dir):
    compared = regression.compare(outputs(spark, sf_dir, False), outputs(spark, sf_dir, True))
    return compared.groupBy("result", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.sum("case_id").alias("case_sum"))


@query
def regression_summary(spark, sf_dir):
    return regression.summary(regression.compare(outputs(spark, sf_dir, False), outputs(spark, sf_dir, True)))


@query
def regression_trend(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_type", "event_id", F.round("value", 2).alias("rate"))
    return regression.trend(runs, "event_id", "rate", ["event_type"]).select("event_type", "event_id", F.round("delta", 2).alias("delta"))


@query
def baseline_confusion(spark, sf_dir):
    n = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(n % 3 == 0, "Normal").when(n % 3 == 1, "Observe").otherwise("Alert").alias("risk"))
    candidate = base.withColumn("risk", F.when(n_mod(10), "Normal").when(n_mod(7), "Alert").otherwise(F.col("risk")))
    return agreement.label_metrics(base, candidate, "case_id", "risk")


def n_mod(k: int) -> F.Column:
    return F.col("case_id") % k == 0


@query
def arbitration_queue(spark, sf_dir):
    n = F.col("o_orderkey")
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (n % 3).alias("a_status"), (n % 9 % 4).alias("b_status"), F.array((n % 5).cast("string"), F.lit("x")).alias("a_rules"), F.array(F.lit("x"), (n % 10 % 6).cast("string")).alias("b_rules"))
    return agreement.arbitration_queue(cases)


# --- shapes of conversations, sources, event time


@query
def moderation_any_flag(spark, sf_dir):
    flags = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.struct(((F.col("conv_id") + F.col("turn")) % 7 == i * 3).alias("flagged")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.exists(flags, lambda f: f["flagged"]).alias("flagged"))
    return rows.groupBy("conv_id").agg(F.max(F.col("flagged").cast("int")).alias("any_flag"), F.count_if("flagged").alias("n_flags"))


@query
def role_requirements(spark, sf_dir):
    return plain_turns(spark, sf_dir).groupBy("conv_id").agg(F.collect_set("role").alias("roles")).select("conv_id", (F.size(F.array_except(F.array(F.lit("user"), F.lit("assistant")), "roles")) == 0).alias("complete"))


@query
def messages_to_turns(spark, sf_dir):
    """Conversations as message arrays, back to turns: blank messages go and ids are given anew."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 1, F.lit("  ")).otherwise(F.col("text")))
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    built = nested.select("conv_id", F.posexplode(turns.build_turns(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))).alias("turn_idx", "t"))
    return built.select("conv_id", "turn_idx", "t.id", "t.role", "t.source_trust", F.length("t.text").alias("n_chars"))


@query
def markdown_transcript_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    name = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "ai").otherwise("SYSTEM")
    line = F.concat(name, F.lit(" : "), F.regexp_replace("text", "\n", "\n  "))
    docs = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    docs = docs.select("conv_id", F.concat(F.lit("---\ntitle: x\n---\nintro line\n"), "body").alias("body"))
    return transcripts.parse_markdown(docs, "conv_id", "body").select("conv_id", "turn_idx", "turn_id", "role", F.length(F.regexp_replace("text", r"\s", "")).alias("n_visible"))


@query
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("start"), "event_type", "n")


@query
def session_gap_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("start"), "n")


@query
def canonical_digests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.canonical_json(F.concat(F.lit('{"z": 1, "p": '), "props", F.lit("}"))).alias("canonical"), tx.short_digest(F.col("props")).alias("digest"))


@query
def uniform_id_checks(spark, sf_dir):
    n = F.lpad((F.col("o_orderkey") * 104729 % 100_000_000).cast("string"), 8, "0")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), n.alias("value"), pii.uniform_id_valid(n).alias("valid"))


# --- validation, corpora


@query
def validation_stages(spark, sf_dir):
    n = F.col("o_orderkey")
    metrics = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (n % 11 / 10).alias("content_validity"), (n % 7 / 6).alias("construct_fit"), F.when(n % 5 != 0, (n % 3 / 2).cast("string")).otherwise("n/a").alias("criterion_correlation"), (n % 2).alias("kappa"), F.lit(0.7).alias("retest_correlation"))
    stages = validation.evaluate_stages(metrics, "case_id")
    return stages.groupBy("stage", "status").agg(F.count("*").alias("n"))


@query
def validation_readiness(spark, sf_dir):
    n = F.col("o_orderkey")
    metrics = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(n % 3 == 0, 0.7).otherwise(0.9).alias("content_validity"), F.lit(0.95).alias("construct_fit"), F.when(n % 4 != 0, F.lit(0.6)).alias("criterion_correlation"), F.lit(0.7).alias("kappa"), F.lit(0.7).alias("retest_correlation"))
    return validation.readiness(validation.evaluate_stages(metrics, "case_id"), "case_id").select("case_id", "failed", "pending", "readiness")


@query
def quota_per_group(spark, sf_dir):
    return validation.quota(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5).select("doc_id", "source", F.col("place").cast("int").alias("place"))


@query
def rule_gaps(spark, sf_dir):
    observed = events.risk_events(injected(spark, sf_dir), drift=False).select(F.when(F.col("rule_id") == "FR_03", "ZZ_01").otherwise(F.col("rule_id")).alias("rule_id"))
    known = spark.createDataFrame([(r[0],) for r in EVENT_RULES], "rule_id string")
    return validation.rule_gaps(observed, known)


@query
def nested_list_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+ing\b"), F.lit(0)).alias("found"))
    return validation.nested_profile(rows, "found", ["lang"]).select("lang", "rows", "elements", "empty", "largest")


@query
def dataset_test_run(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    made = F.transform("m", lambda x: F.struct(F.concat(F.lit("T"), (x["turn"] + 1).cast("string")).alias("id"), x["role"].alias("role"), x["text"].alias("text"), F.lit("trusted").alias("source_trust"), F.lit(False).alias("boundary_bypass")))
    sets = nested.select("conv_id", F.when(F.col("conv_id") % 3 == 0, "a").otherwise("b").alias("dataset"), F.lit("en").alias("language"), made.alias("turns"))
    return datasets.run(sets, {"a": 2, "b": 1}, 30, config=Config(deidentify=False))["summary"]


@query
def report_markdown(spark, sf_dir):
    report = injected_run(spark, sf_dir).report
    return report.select("conv_id", F.sha2(sinks.report_markdown("Report", ["decision", "risk_status", "stability_index"]), 256).alias("sha"))


# --- annotations, generated cases, corpora


@query
def annotation_items(spark, sf_dir):
    run = injected_run(spark, sf_dir)
    return annotations.event_items(run.events, run.signals)


@query
def annotation_normalized(spark, sf_dir):
    n = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        n.alias("conversationId"), F.when(n % 11 == 0, "  ").otherwise(F.concat(F.lit(" T"), (n % 9).cast("string"))).alias("turnId"), F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit("r"), (n % 4).cast("string"))).alias("rater_id"),
        F.when(n % 5 == 0, " gen").alias("axis"), F.when(n % 6 != 0, F.concat(F.lit("fr_0"), (n % 7).cast("string"))).alias("eventCode"), F.when(n % 8 == 0, "none").otherwise((F.col("value") - 10).cast("string")).alias("severity"),
        F.when(n % 10 != 0, F.col("value") / 30).alias("confidence"), F.concat(F.col("event_type"), F.lit(" ")).alias("notes"),
    )
    return annotations.normalized_items(raw)


@query
def rated_case_errors(spark, sf_dir):
    n = F.col("o_orderkey")
    scores = lambda axis, wrong: F.create_map(F.lit(axis), F.when(wrong, 101.0).otherwise(40.0))
    cases = table(spark, sf_dir, "orders").select(
        n.alias("case_id"), F.when(n % 13 == 0, "odd").otherwise(" Alert ").alias("a_risk_status"), F.when(n % 17 != 0, "Normal").alias("b_risk_status"), scores("FR", n % 7 == 0).alias("a_scores"), scores("SA", n % 5 == 0).alias("b_scores"),
        F.array(F.lit(" b "), F.lit("a"), F.lit("a")).alias("a_rules"), F.lit(None).cast("array<string>").alias("b_rules"),
    )
    _, wrong = annotations.rated_cases(cases)
    return wrong.select("case_id", F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"), F.sum("case_id").alias("case_sum"))


@query
def personal_cases(spark, sf_dir):
    cases = synthetic.personal_cases(spark, 2000)
    return cases.withColumn("valid", pii.valid_value(F.col("detector_type"), F.col("value")))


def _corpus(spark, sf_dir) -> DataFrame:
    nested = plain_turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "role", "text", "source_trust", "boundary_bypass"))).alias("turns"))
    return corpus.stage_corpus(spark, nested, nested, nested, nested)


@query
def stage_corpus_summary(spark, sf_dir):
    return corpus.stage_summary(_corpus(spark, sf_dir))


@query
def stage_corpus_risk(spark, sf_dir):
    return corpus.with_risk(_corpus(spark, sf_dir)).groupBy("risk_status").agg(F.count("*").alias("n"))


@query
def ground_truth_manifest(spark, sf_dir):
    source = injected(spark, sf_dir)
    family = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("conv_id") % 3 + 1).cast("int"))
    cases = ground_truth.chosen(source.select("conv_id").distinct().select(F.col("conv_id").alias("case_id"), family.alias("family")), {"x": 7, "y": 5})
    manifest = ground_truth.expand(cases, source, Config(deidentify=False))["manifest"]
    return manifest.select("case_id", "family", "decision", "risk_status", F.array_join("event_rules", ",").alias("event_rules"), F.array_join("signal_rules", ",").alias("signal_rules"))
