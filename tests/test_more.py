"""Fixtures, contracts, languages, surrogate values, annotations, corpora, ground truth, event logs, streams against the batch."""

import json
import os
import pathlib
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from parley.functions import pii
from parley.functions import text as tx
from parley.operators import agreement, annotations, deid, filtering, gate, ledger, turns
from parley.plans import ground_truth, queries, risk
from parley.rules import EVENT_RULES, SIGNAL_RULES
from parley.sources import corpus, scans, synthetic, transcripts
from parley.streaming import jobs

TURNS = "conv_id long, turn_idx int, turn_id string, role string, text string, source_trust string, boundary_bypass boolean"
GOLDEN = {
    "calm": ("Normal", ["When does the desk open?", "At nine on weekdays.", "Thanks."]),
    "drift": ("Observe", ["Please keep to the plan.", "There is an ambiguous reference in my note.", "I see."]),
    "claim": ("Deviate", ["Is this known?", "It is an unsupported claim so far.", "Then leave it out."]),
    "conflict": ("Deviate", ["Do as the first note says.", "I see an instruction conflict between the notes.", "Tell me more."]),
    "grave": ("Alert", ["He asks for a violence instruction.", "I won't help with that.", "Good."]),
    "worst": ("Alert", ["a credential request came in", "and a malware instruction with it", "stop"]),
}


def test_goldens_by_pairs(spark, tmp_path):
    """Pairs of input and expected files; the analysis agrees with all of them."""
    for name, (status, texts) in GOLDEN.items():
        given = [{"id": f"T{i + 1}", "role": ("user", "assistant")[i % 2], "text": t, "sourceTrust": "trusted", "boundaryBypass": False} for i, t in enumerate(texts)]
        (tmp_path / f"{name}.input.json").write_text(json.dumps({"turns": given}))
        (tmp_path / f"{name}.expected.json").write_text(json.dumps({"expected": {"risk_status": status}}))
    (tmp_path / "alone.input.json").write_text("{}")
    pairs = transcripts.fixture_pairs(spark, str(tmp_path))
    assert sorted(r.name for r in pairs.collect()) == sorted(GOLDEN)
    cases = pairs.select(F.col("name").alias("conv_id"), transcripts.contract_turns(F.col("input")).alias("turns"))
    report = risk.run(turns.from_arrays(cases)).report
    expected = pairs.select(F.col("name").alias("conv_id"), F.get_json_object("expected", "$.expected.risk_status").alias("risk_status"))
    row = agreement.label_metrics(expected, report, "conv_id", "risk_status").first()
    assert (row.compared, row.accuracy) == (len(GOLDEN), 1.0)


def test_contracts(spark, tmp_path):
    one = {"id": "T1", "role": "user", "text": "hi", "sourceTrust": "trusted"}
    (tmp_path / "a.json").write_text(json.dumps({"turns": [one]}))
    (tmp_path / "b.json").write_text(json.dumps({"steps": {"input": {"turns": [one, {"id": "T2", "text": "yes"}]}}}))
    (tmp_path / "c.md").write_text("user: hello\nai: there")
    (tmp_path / "d.json").write_text("{}")
    rows, lacking = transcripts.contracts(spark, str(tmp_path))
    assert sorted((r.conv_id, r.turn_id, r.role) for r in rows.collect()) == [("a", "T1", "user"), ("b", "T1", "user"), ("b", "T2", "user"), ("c", "T001", "user"), ("c", "T002", "assistant")]
    assert [r.conv_id for r in lacking.collect()] == ["d"]
    blank = annotations.template(rows).where("conversation_id = 'b'").first()
    assert (blank.batch_id, blank.target_count, blank.completed_count, blank.rater_a) == ("pilot-study-001", 100, 0, []) and [t.turn_id for t in blank.turns] == ["T1", "T2"]


def test_languages(spark):
    rows = [
        ("the cat and the dog", None, None, "en"), ("der Hund und die Katze", None, None, "de"), ("你好世界 this", None, None, "zh"), ("你好 the of and to in is that it", "zh", None, "en"), ("漢字漢 the of and", "zh", None, "zh"), ("こんにちは世界", None, None, "ja"),
        ("der Hund und die Katze", "en-US", None, "en"), ("привет мир", None, None, "ru"), ("привет мир", "en", None, "en"), ("", None, "zh-TW", "zh"), ("1234 !!", None, None, "unknown"), (None, None, " ", "unknown"), ("xyzzy", "en", "fr", "fr"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, expected string, meta string, want string")
    got = df.select("i", "want", tx.detect_language(F.col("text"), F.col("expected"), F.col("meta")).alias("got")).orderBy("i").collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]
    body = "the answer of it is that we are with you as it was"
    source = spark.createDataFrame([(c, t, r, body) for c in (1, 2) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn_idx int, role string, text string")
    assert {r.conv_id: (r.bucket, r.reason) for r in filtering.evaluate(source, None).collect()} == {1: ("primary", None), 2: ("removed", "duplicate_text_hash")}


def test_case_text(spark):
    df = spark.createDataFrame([([("A b",), (None,), ("C",)],), ([(" ",)],), ([],)], "turns array<struct<text:string>>")
    assert [r.t for r in df.select(tx.case_text(F.col("turns")).alias("t")).collect()] == ["a b\n\nc", None, None]


def brute_materialized(text, record, entities):
    first, last = ["Jordan", "Casey", "Avery", "Morgan", "Taylor"], ["Lee", "Chen", "Patel", "Wang", "Lin"]

    def value(kind, n):
        eight = f"{n:08d}"[-8:]
        return {"email": f"contact{n:04d}@example.org", "phone": f"09{eight[:2]}-{eight[2:5]}-{eight[5:]}", "url": f"https://example.org/profile/{n:04d}", "address": f"{100 + n} Example Road, Austin, TX", "name": f"{first[n % 5]} {last[n // 5 % 5]}", "id_num": f"ID-{n:08d}"}.get(kind, f"[{kind.upper()}_{n:04d}]")

    out, truth, at = "", [], 0
    for k, (start, stop, kind) in enumerate(entities):
        out += text[at:start]
        made = value(kind, record * 10 + k)
        if start and text[start - 1].isalnum() and made[0].isalnum():
            made = " " + made
        if stop < len(text) and text[stop].isalnum() and made[-1].isalnum():
            made += " "
        truth.append((kind, kind if kind in ("email", "phone") else None, len(out), len(out) + len(made), made))
        out += made
        if kind == "phone" and text[stop : stop + 1] in (".", ","):
            out += " "
        at = stop
    return out + text[at:], truth


def test_surrogates_against_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for i in range(200):
        text = "".join(draw.choice("ab é.,1 漢") for _ in range(40))
        cuts = sorted(draw.sample(range(41), 2 * draw.randint(0, 4)))
        rows.append((i, i * 37, text, [(a, b, draw.choice(["email", "phone", "url", "address", "name", "id_num", "org"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
    df = spark.createDataFrame(rows, "id int, record int, text string, entities array<struct<start:int,stop:int,kind:string>>")
    got = {r.id: (r.text, [tuple(t) for t in r.truth]) for r in deid.materialized(df).collect()}
    assert got == {i: brute_materialized(t, n, e) for i, n, t, e in rows}
    for text, truth in got.values():
        assert all(text[a:b] == v for _, _, a, b, v in truth)


def test_generated_cases(spark):
    cases = synthetic.personal_cases(spark, 300).unionByName(synthetic.query_secret_cases(spark, 20))
    rows = cases.withColumn("valid", pii.valid_value(F.col("detector_type"), F.col("value"))).collect()
    assert len(rows) == 1520 and all(r.text[r.start : r.stop] == r.value and r.valid == (r.detector_type != "query_secret") for r in rows)
    assert not any(r.v for r in spark.createDataFrame([("tw_phone", "0912"), ("address", "x"), ("other", "1"), ("credit_card", "4111")], "d string, v string").select(pii.valid_value(F.col("d"), F.col("v")).alias("v")).collect())


def test_skipped_spans_are_warned_of(spark):
    many = " ".join(f"a{i}@b.org" for i in range(7))
    df = spark.createDataFrame([(1, 0, "T001", "user", many, "trusted", False), (2, 0, "T001", "user", "a@b.org", "trusted", False)], TURNS)
    run = risk.run(df, risk.Config(most_per_type=4))
    assert run.replacements.where("conv_id = 1").count() == 4
    got = {r.conv_id: [(w.stage, w.id) for w in r.false_positive_warnings] for r in run.report.collect()}
    assert got == {1: [("deid", "audit-max-per-type-email")], 2: []}
    assert risk.run(df).replacements.count() == 8
    assert risk.report_checks(run.report).where(F.size("errors") > 0).count() == 0


def test_long_evidence_is_a_schema_finding(spark):
    text = "broken evidence link, privacy leak, crash loop " + "padding words " * 20
    df = spark.createDataFrame([(1, 0, "T001", "user", text, "trusted", False), (2, 0, "T001", "user", "crash loop", "trusted", False)], TURNS)
    rows = {r.conv_id: r for r in risk.run(df).report.collect()}
    assert len(rows[1].e) > gate.EVIDENCE_MOST and "check-tests-failed" in rows[1].gate_findings and "check-tests-failed" not in rows[2].gate_findings


def test_annotations(spark):
    raw = spark.createDataFrame([(" T1 ", "fr_01", "9", "2"), ("T2", None, "nan", None), (" ", "x", "1", "1"), ("T3", "ca_02", "-1", "x")], "turnId string, event_code string, severity string, confidence string")
    got = [tuple(r) for r in annotations.normalized_items(raw, "rater_B").orderBy("turn_id").collect()]
    assert got == [(None, "T1", "rater_B", "FR", "FR_01", 4.0, 1.0, ""), (None, "T2", "rater_B", "UNSPECIFIED", "UNSPECIFIED", 0.0, 0.8, ""), (None, "T3", "rater_B", "CA", "CA_02", 0.0, 0.8, "")]
    cases = spark.createDataFrame([("c1", " Alert ", {"FR": 10.0}, [" b", "a", "a", ""], "Normal", {}, None), ("c2", "Odd", {"SR": 101.0}, [], "Alert", {"CA": -1.0}, []), (" ", "Alert", {}, [], "Alert", {}, [])], "case_id string, a_risk_status string, a_scores map<string,double>, a_rules array<string>, b_risk_status string, b_scores map<string,double>, b_rules array<string>")
    good, wrong = annotations.rated_cases(cases)
    row = good.first()
    assert good.count() == 1 and (row.a_status, row.a_FR, row.a_CA, row.a_rules, row.b_rules) == ("Alert", 10.0, 0.0, ["a", "b"], [])
    assert {r.case_id: r.errors for r in wrong.collect()} == {"c2": ["a: risk_status", "a: SR outside 0 to 100", "b: CA outside 0 to 100"], " ": ["case without id"]}


def test_stage_corpus(spark):
    pool = spark.range(120).select(F.col("id").alias("conv_id"), F.array(F.struct(F.lit("T001").alias("id"), F.lit("user").alias("role"), F.lit("plain").alias("text"))).alias("turns"))
    cases = corpus.with_risk(corpus.stage_corpus(spark, pool, pool, pool, pool))
    assert cases.count() == 1700 == cases.select("case_id").distinct().count()
    assert {r.stage: (r.actual, r.coverage) for r in corpus.stage_summary(cases).collect()} == {s: (n, 1.0) for s, n in corpus.STAGE_TARGETS.items()}
    assert {r.risk_status: r["count"] for r in cases.groupBy("risk_status").count().collect()} == {"Normal": 680, "Observe": 425, "Deviate": 340, "Alert": 255}
    fits = cases.where(F.array_contains("wanted", F.col("risk_status"))).count()
    assert fits > 1500
    rules = cases.where("stage = 'Event Engine' and element_at(marks, 'rule_id') is not null").select("case_id", F.col("marks.rule_id").alias("rule"), transcripts.contract_turns(F.col("input")).alias("turns"))
    found = risk.run(turns.from_arrays(rules.withColumnRenamed("case_id", "conv_id")), risk.Config(deidentify=False)).events.select("conv_id", "rule_id").distinct()
    assert rules.join(found, (F.col("case_id") == F.col("conv_id")) & (F.col("rule") == F.col("rule_id")), "left_anti").count() == 0


def test_ground_truth(spark, sf_dir):
    source = queries.injected(spark, sf_dir)
    cases = source.select("conv_id").distinct().select(F.col("conv_id").alias("case_id"), F.when(F.col("conv_id") % 2 == 0, "x").otherwise("y").alias("family"))
    picked = ground_truth.chosen(cases, {"x": 4, "y": 30}, None)
    assert {r.family: r["count"] for r in picked.groupBy("family").count().collect()} == {"x": 4, "y": 10}
    out = ground_truth.expand(picked, source, risk.Config(deidentify=False))
    row = out["summary"].first()
    assert row.total == 14 and row.sources == {"x": 4, "y": 10} and row.kappa == 1.0 and not row.enough_cases and row.event_rules_unknown == []
    assert row.event_rules_covered == len({x for r in out["manifest"].collect() for x in r.event_rules}) <= len(EVENT_RULES) and row.signal_rules_covered <= len(SIGNAL_RULES)
    by_scene = ground_truth.chosen(cases.withColumn("scene", F.col("case_id") % 3), {"x": 5}, "scene")
    assert by_scene.count() == 5 and by_scene.select("scene").distinct().count() == 3


def test_event_logs(spark):
    rows = [("a", i, f"e{i}", "FR", "low", t) for i, t in enumerate([0, 2, None, 1, -1, 1, 3])] + [("b", 0, " ", "XX", None, 5), ("b", 1, "x", "SA", "high", 5)]
    df = spark.createDataFrame(rows, "case_id string, place int, event_id string, axis string, severity string, turn_index int")
    got = {(r.case_id, r.place): r.findings for r in gate.event_log_findings(df).collect() if r.findings}
    assert got == {("a", 2): ["event-turn-index-invalid"], ("a", 3): ["event-turn-order-violation"], ("a", 4): ["event-turn-index-invalid"], ("b", 0): ["event-id-missing", "event-axis-invalid", "event-severity-invalid"]}
    assert [r.c for r in spark.createDataFrame([("GO",), ("NO_GO",), (None,)], "d string").select(gate.exit_code(F.col("d")).alias("c")).collect()] == [0, 1, 2]


def test_settings():
    made = risk.configured({"cap": 2, "gate": {"maxima": {"high_open": 1}}}, risk.Config(gate={"near": 0.8, "maxima": {"critical_open": 2}}))
    assert (made.cap, made.gate) == (2, {"near": 0.8, "maxima": {"critical_open": 2, "high_open": 1}})
    with pytest.raises(ValueError, match="unknown settings: caps"):
        risk.configured({"caps": 1})


def test_audit(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    rows, state = scans.audit(spark, {"required": {"docs": ["a.txt"]}, "reference": {"docs": ["b.txt"]}}, f"file://{tmp_path}")
    assert state == "READY" and {(r.path, r.exists) for r in rows.collect()} == {("a.txt", True), ("b.txt", False)}
    assert scans.audit(spark, {"required": {"docs": ["b.txt"]}}, f"file://{tmp_path}")[1] == "NOT_READY"


def test_long_files_are_scanned_whole(spark, tmp_path):
    (tmp_path / "late.txt").write_bytes(b"a" * 9000 + b"\0token = 'abcdefghijklmnopq'")
    (tmp_path / "text.txt").write_text("a " * 9000 + "\ntoken = 'abcdefghijklmnopq'")
    assert [r.id.rpartition("/")[2] for r in scans.source_secrets(spark, str(tmp_path)).collect()] == ["text.txt"]


def test_own_turns_pass_their_check(spark):
    rows = turns.from_rows(spark.createDataFrame([(1, i, "user", "a") for i in range(3)], "conv_id long, turn long, role string, text string"))
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn_id").alias("id"), "role", "text", "source_trust", "boundary_bypass"))).alias("turns"))
    assert nested.select(turns.record_errors(F.col("turns")).alias("e")).first().e == []


def test_common_characters_and_words(spark):
    """Exact at every share, whatever the letters; first words only settle what they can."""
    draw = random.Random(6)
    texts = ["", "aaab", "漢" * 70 + "字" * 30, "漢" * 60 + "字" * 40, "aA" * 50, "-" * 65 + "ab" * 17 + "c"] + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for letters in ("aaaaab", "abc", "zzzzzzz1", "..!", "éééééa", "hi") for _ in range(30)]
    words = ["spam " * 20, "one two " * 300, "x " * 200 + "tail end of it", "a b c " * 3, "word " * 7, "w" * 500 + " spam" * 9]
    df = spark.createDataFrame([(t,) for t in texts + words], "t string")
    got = df.select("t", filtering.has_common_character(F.col("t"), 0.65).alias("c"), filtering.has_repeated_words(F.col("t"), 8, 2).alias("w")).collect()
    for r in got:
        own = re.findall(r"\w+", r.t.lower())
        assert bool(r.c) == (not r.t or max(map(r.t.count, set(r.t))) >= 0.65 * len(r.t)), r.t
        assert r.w == (len(set(own)) <= 2 and max(map(own.count, set(own)), default=0) >= 8), r.t


def test_stream_gives_the_batch_ledger(spark, sf_dir, tmp_path):
    """Two micro-batches in the events' order decide as the whole table does, for keys of both ledgers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    rows = queries.ledger_input(spark, sf_dir).join(e.select(F.col("event_id").cast("string").alias("event_id"), "ts"), "event_id")
    middle = e.selectExpr("percentile_approx(ts, 0.5) AS m").first().m
    columns = ["conv_id", "ledger_type", "entry_key", "turn_idx", "resolved", "ts"]
    for i, part in enumerate((F.col("ts") <= F.lit(middle), F.col("ts") > F.lit(middle))):
        rows.where(part).select(*columns).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        shutil.copy(next(pathlib.Path(tmp_path / f"in{i}").glob("*.parquet")), tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    schema = spark.read.parquet(str(tmp_path / "in0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    query = jobs.repeat_ledger(stream, idle="3650 days").writeStream.format("memory").queryName("batch_ledger").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    count = lambda df: {tuple(r)[:-1]: r["count"] for r in df.groupBy("conv_id", "ledger_type", "entry_key", "turn_idx", "repeat_count", "status").count().collect()}
    assert count(spark.table("batch_ledger")) == count(ledger.repeat_chains(queries.ledger_input(spark, sf_dir)))
