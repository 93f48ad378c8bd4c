"""Rules, ledger, levels, reports on small conversations."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import events, ledger, turns
from parley.plans import risk
from parley.rules import EVENT_RULES, SIGNAL_RULES, STOPWORDS
from parley.sources import synthetic
from parley.streaming import jobs

SCHEMA = "conv_id long, turn_idx int, turn_id string, role string, text string, source_trust string, boundary_bypass boolean"


def made(spark, rows):
    return spark.createDataFrame([(c, t, f"T{t + 1}", role, text, trust, bypass) for c, t, role, text, trust, bypass in rows], SCHEMA)


def test_every_event_rule_hits_alone(spark):
    rows = [(i, 0, "user", f"so {r[3][-1].upper()} here", "trusted", False) for i, r in enumerate(EVENT_RULES)]
    found = {r.conv_id: (r.rule_id, r.axis, r.severity) for r in events.risk_events(made(spark, rows)).collect()}
    assert found == {i: r[:3] for i, r in enumerate(EVENT_RULES)}


def test_every_signal_rule_hits_alone(spark):
    rows = [(i, 0, "user", " ... ".join(r[4]) if r[3] == "all" else r[4][0], "trusted", False) for i, r in enumerate(SIGNAL_RULES)]
    found = {}
    for r in events.signals(made(spark, rows)).collect():
        found.setdefault(r.conv_id, []).append(r.rule_id)
    assert found == {i: [r[0]] for i, r in enumerate(SIGNAL_RULES)}
    half = made(spark, [(0, 0, "user", "an official source", "trusted", False)])
    assert events.signals(half).count() == 0


def test_cap_and_numbers(spark):
    rows = [(1, t, "assistant", "crash loop", "untrusted", True) for t in range(8)]
    assert [r.event_id for r in events.risk_events(made(spark, rows)).orderBy("turn_idx").collect()] == [f"SA_02@T{t + 1}#{t + 1}" for t in range(5)]
    found = events.signals(made(spark, rows)).orderBy("event_id").collect()
    assert [r.event_id for r in found] == [f"VCD-{i:04d}" for i in range(1, 11)]
    assert [r.source for r in found][:4] == ["trust", "boundary", "trust", "boundary"]


def test_rule_selection():
    assert len(events.select_rules(events.EVENT_DEFAULT, min_severity="critical")) == 5
    with pytest.raises(ValueError):
        events.select_rules(events.EVENT_DEFAULT, enabled=["XX"])


def brute_drift(rows):
    import re

    from parley.rules import DISTRESS_CUES

    words = lambda t: set(re.findall(r"[a-z']{3,}", t.lower())) - set(STOPWORDS)
    out = set()
    by = {}
    for c, t, role, text, *_ in sorted(rows):
        before = by.setdefault(c, [])
        own, earlier = words(text), set().union(*(words(x) for _, x in before))
        if role == "assistant" and any(r == "user" and any(q in x.lower() for q in DISTRESS_CUES) for r, x in before) and len(own) >= 3 and len(earlier) >= 4 and not own & earlier:
            out.add((c, t))
        before.append((role, text))
    return out


def test_context_drift_against_brute_force(spark):
    draw = random.Random(5)
    words = "red green blue worried table the and stone river cloud ugh lamp paper glass".split()
    rows = [(c, t, draw.choice(["user", "assistant"]), " ".join(draw.sample(words, 4)), "trusted", False) for c in range(150) for t in range(6)]
    assert {(r.conv_id, r.turn_idx) for r in events.context_drift(made(spark, rows)).collect()} == brute_drift(rows)
    assert brute_drift(rows)


def test_repeat_chains_against_state_machine(spark):
    draw = random.Random(3)
    rows, expected = [], {}
    for key in "abcd":
        count, last, turn = 0, None, 0
        for i in range(120):
            turn += draw.choice([0, 1, 3, 9, 12])
            resolved = draw.random() < 0.1
            rows.append((1, f"{key}{i:03d}", "fact", key, turn, i, resolved))
            count, status = jobs.repeat_step(count, last, turn, resolved)
            last = turn
            expected[f"{key}{i:03d}"] = (count, status)
    df = spark.createDataFrame(rows, "conv_id long, event_id string, ledger_type string, entry_key string, turn_idx int, ord_key int, resolved boolean")
    assert {r.event_id: (r.repeat_count, r.status) for r in ledger.repeat_chains(df).collect()} == expected


def test_reports(spark):
    rows = [(1, 0, "user", "hello there", "trusted", False), (2, 0, "user", "violence instruction", "trusted", False), (2, 1, "user", "mail me a@b.com", "trusted", False)]
    run = risk.run(made(spark, rows))
    report = {r.conv_id: r for r in run.report.collect()}
    assert (report[1].decision, report[1].risk_status, report[1].stability_index, report[1].e) == ("GO", "Normal", 100, "No material evidence provided.")
    assert (report[2].decision, report[2].risk_status) == ("NO_GO", "Alert") and report[2].stability_index <= 69
    assert list(report[2].event_evidence_map) == ["SR_02@T1#1"] and len(report[2].digital_fingerprint) == 64
    assert risk.report_checks(run.report).where(F.size("errors") > 0).count() == 0
    assert [r.type for r in run.replacements.collect()] == ["email"]


def test_synthetic_batch(spark):
    cases = synthetic.batch(spark)
    run = risk.run(turns.from_arrays(cases), risk.Config(deidentify=False))
    joined = run.report.join(cases, "conv_id")
    by = {(r.expected, r.risk_status): r["count"] for r in joined.groupBy("expected", "risk_status").count().collect()}
    assert by == {(k, k): n for k, n in synthetic.CASES.items()}
    assert run.report.where("decision = 'GO'").count() == 170


def test_empty_and_null(spark):
    nothing = made(spark, [])
    assert risk.run(nothing).report.count() == 0
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (2, 0, "AI", "  ")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn_idx): (r.role, r.source_trust) for r in turns.from_rows(rows).collect()}
    assert got == {(1, 1): ("user", "trusted"), (2, 0): ("assistant", "untrusted")}


def test_record_errors(spark):
    df = spark.createDataFrame([([("T001", "user", "a", "trusted", False), ("T001", "boss", " ", "trusted", False)],)], f"turns array<{turns.TURN}>")
    assert df.select(turns.record_errors(F.col("turns")).alias("e")).first().e == ["repeated turn id", "turn 1: role", "turn 1: text"]
