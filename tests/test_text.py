"""Personal data, filters, samples, agreement, sources, sinks, streams."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import pii
from parley.functions import text as tx
from parley.operators import agreement, deid, filtering, profile, regression, sampling
from parley.sources import sinks, synthetic, transcripts
from parley.streaming import jobs


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    found = []
    for det, (kind, pattern) in enumerate(pii.DETECTORS.items()):
        if kind == "query_secret":
            keys = pattern.split("(?:")[1].split(")")[0]
            found += [(m.start(3), -m.end(3), det, kind, m[3]) for m in re.finditer(rf"(?i)([?&])({keys})=([^&#\s]+)", text, re.A)]
            continue
        for m in re.finditer(pattern, text, re.A):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "phone" and not (8 <= len(digits) <= 15 and not re.search(r"(?:\d{1,3}\.){3}\d{1,3}", m[0])):
                continue
            if kind == "credit_card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "tw_national_id":
                code = "ABCDEFGHJKLMNPQRSTUVXYWZIO".index(m[0][0]) + 10
                if (code // 10 + 9 * (code % 10) + sum(w * int(c) for w, c in zip((8, 7, 6, 5, 4, 3, 2, 1, 1), m[0][1:], strict=True))) % 10:
                    continue
            found.append((m.start(), -m.end(), det, kind, m[0]))
    out, cursor = [], -1
    for x in sorted(found):
        if x[0] >= cursor:
            out.append(x)
            cursor = -x[1]
    return out


def pii_texts():
    draw = random.Random(9)
    parts = ["a.b@c.org", "請x@y.tw ", "+886 912-345-678", "10.0.0.255", "1.2.3.4.5", "A123456789", "B100000002", "4111 1111 1111 1111", "4111111111111112", "?token=abc&Secret=x#", "é", " ", "tel (02) 2345-6789", "99", "\n"]
    return ["", *("".join(draw.choice(parts) + draw.choice(["", " ", ", "]) for _ in range(draw.randint(1, 12))) for _ in range(300))]


def test_spans_against_brute_force(spark):
    texts = pii_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pii.spans(F.col("text")).alias("s"))
    got = {r.i: [tuple(x) for x in r.s] for r in df.collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_redaction(spark):
    df = spark.createDataFrame([(1, 0, "mail a@b.com and a@c.com"), (1, 1, "call 0912345678 x@y.org"), (2, 0, "nothing"), (3, 0, None)], "conv_id long, turn_idx int, text string")
    rows = deid.replacements(df)
    got = {(r.conv_id, r.turn_idx): r.text for r in deid.redact(df, rows).collect()}
    assert got == {(1, 0): "mail [EMAIL_1] and [EMAIL_2]", (1, 1): "call [PHONE_1]_*78 [EMAIL_3]", (2, 0): "nothing", (3, 0): None}
    assert rows.where("type = 'phone'").first().digest == hashlib.sha256(b"0912345678").hexdigest()[:16]


def test_per_type_cap(spark):
    df = spark.createDataFrame([(" ".join(f"a{i}@b.org" for i in range(5)),)], "text string")
    assert len(df.select(pii.spans(F.col("text"), most_per_type=3).alias("s")).first().s) == 3


def test_synthetic_personal_data(spark):
    rows = synthetic.personal_data(spark, 60)
    checks = rows.select("kind", F.when(F.col("kind") == "credit_card", pii.luhn_valid(F.col("value"))).when(F.col("kind") == "phone", pii.likely_phone(F.col("value"))).otherwise(pii.national_id_valid(F.col("value"))).alias("ok"))
    assert checks.where("not coalesce(ok, false)").count() == 0 and rows.count() == 180


def test_noise_reasons(spark):
    texts = ["", "short", "a" * 40, "!?" * 30 + "a", "spam " * 20, "a perfectly usual sentence of many words"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(filtering.noise_reason(F.col("t"), filtering.Filter()).alias("r"))
    assert [r.r for r in df.collect()] == ["too_short", "too_short", "repeated_character", "few_letters", "repeated_word", None]


def test_duplicates_only_after_kept_ones(spark):
    body = "these are quite enough visible characters"
    rows = [(c, t, r, body) for c in range(4) for t, r in enumerate(("user", "assistant"))] + [(9, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn_idx int, role string, text string")
    languages = spark.createDataFrame([(0, "xx"), (1, "en"), (2, "EN-gb"), (3, "zh-TW"), (9, "en")], "conv_id long, language string")
    got = {r.conv_id: (r.bucket, r.reason) for r in filtering.evaluate(df, languages).collect()}
    assert got == {0: ("removed", "unsupported_language"), 1: ("primary", None), 2: ("removed", "duplicate_text_hash"), 3: ("removed", "duplicate_text_hash"), 9: ("removed", "missing_required_roles_after_cleaning")}


def test_round_robin(spark):
    rows = [("a", i) for i in range(5)] + [("b", i) for i in range(2)]
    df = spark.createDataFrame(rows, "g string, i int")
    got = [r.sample_id for r in sampling.weighted_round_robin(df, "g", "i", {"a": 2, "b": 1}, 6).collect()]
    assert got == ["a-0001", "a-0002", "b-0001", "a-0003", "a-0004", "b-0002"]
    assert sampling.largest_remainder(10, {"a": 0.55, "b": 0.25, "c": 0.2}) == {"a": 5, "b": 3, "c": 2}
    assert sampling.assign({"x": ["A", "B"], "y": ["A"]}, {"A": 1, "B": 1}) == {"y": "A", "x": "B"}


def test_kappa_icc_and_progress(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (0, 0)], "a int, b int")
    row = agreement.kappa(df, "a", "b").first()
    assert (row.n, row.observed, row.kappa) == (4, 0.75, 0.5)
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert agreement.kappa(same, "a", "b").first().kappa == 1.0
    scores = spark.createDataFrame([(9.0, 8.0), (6.0, 5.0), (8.0, 8.0), (7.0, 6.0), (10.0, 9.0)], "a double, b double")
    k, n = 2, 5
    data = [(9, 8), (6, 5), (8, 8), (7, 6), (10, 9)]
    grand = sum(map(sum, data)) / (n * k)
    msr = k * sum((sum(r) / k - grand) ** 2 for r in data) / (n - 1)
    msc = n * sum((sum(r[j] for r in data) / n - grand) ** 2 for j in range(k)) / (k - 1)
    sse = sum((data[i][j] - sum(data[i]) / k - sum(r[j] for r in data) / n + grand) ** 2 for i in range(n) for j in range(k))
    mse = sse / ((n - 1) * (k - 1))
    assert agreement.icc_2_1(scores, "a", "b").first().icc == pytest.approx((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), abs=1e-6)
    batches = spark.createDataFrame([("x", None, 1, 1), ("x", None, 1, 0)], "batch_id string, declared int, a_items int, b_items int")
    assert agreement.progress(batches).first().asDict() == {"batch_id": "x", "target": 2, "completed": 1, "pending": 1, "rate": 0.5}


def test_regression_kinds(spark):
    base = spark.createDataFrame([("a", '{"x":1,"y":2}'), ("b", "1"), ("c", '"t"'), ("d", "[1]"), ("e", "1")], "case_id string, output string")
    cand = spark.createDataFrame([("a", '{"y":2,"x":1}'), ("b", '"1"'), ("c", '"u"'), ("d", "[2]"), ("f", "1")], "case_id string, output string")
    got = {r.case_id: (r.result, r.kind) for r in regression.compare(base, cand).collect()}
    assert got == {"a": ("match", None), "b": ("mismatch", "type"), "c": ("mismatch", "text"), "d": ("mismatch", "structure"), "e": ("missing", None), "f": ("unexpected", None)}
    bars = regression.thresholds(spark.createDataFrame([(0.9, 0.2)], "accuracy double, fpr double"), {"accuracy": 0.85}, {"fpr": 0.15}).first()
    assert (bars.missed, bars.decision) == (["fpr"], "FAIL")


def test_markdown_and_yaml(spark):
    text = "---\ntitle: t\n---\nignored\nUser: hi\nmore\nAI:  yes \nSystem: end"
    df = spark.createDataFrame([("d", text), ("e", "---\nnever closed\nuser: x"), ("f", None), ("g", "no speaker")], "id string, body string")
    got = [(r.conv_id, r.turn_id, r.role, r.text) for r in transcripts.parse_markdown(df, "id", "body").orderBy("conv_id", "turn_idx").collect()]
    assert got == [("d", "T001", "user", "hi\nmore"), ("d", "T002", "assistant", "yes"), ("d", "T003", "system", "end"), ("e", "T001", "user", "x")]
    values, faults = transcripts.parse_yaml("a: 1\nb:\n  c: true # note\n  d: 'x'\n- bad\n__proto__: 1\ne: null")
    assert values == {"a": 1, "b": {"c": True, "d": "x"}, "e": None} and len(faults) == 2


def test_shapes_and_bio(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", " "), ("gpt", "r")], "m")], "id long, conversations array<struct<`from`:string,value:string>>, model string")
    row = transcripts.from_messages(df, "id", "conversations", "from", "value", ["model"]).first()
    assert [(t.id, t.role, t.source_trust) for t in row.turns] == [("T001", "user", "trusted"), ("T002", "assistant", "untrusted")] and row.meta == {"model": "m"}
    assert transcripts.shape_of(["id", "history"]) == "history"
    tokens = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate([("I", "O"), ("am", "O"), ("Ann", "B-name"), ("Lee", "I-name"), ("Bob", "B-name")])], "id int, place int, token string, tag string")
    assert sorted((r.kind, r.start, r.stop, r.value) for r in transcripts.bio_spans(tokens).collect()) == [("name", 5, 12, "Ann Lee"), ("name", 13, 16, "Bob")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"a": 1}, {"a": 2}]}')
    assert [r.a for r in transcripts.read(spark, str(tmp_path / "a.json")).collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\nnot json\n')
    good, bad = transcripts.read_checked(spark, str(tmp_path / "b.jsonl"), "a int")
    assert [r.a for r in good.collect()] == [1] and [r.line for r in bad.collect()] == ["not json"]
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, bucket string")
    sinks.write_jsonl(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_jsonl(df, str(tmp_path / "out"))
    records, report = sinks.convert(df, F.struct("a"), F.filter(F.array(F.when(F.col("bucket").isNull(), F.lit("no bucket"))), lambda e: e.isNotNull()))
    assert [r.a for r in records.collect()] == [1] and report.first().asDict() == {"seen": 2, "failed": 1, "errors": ["no bucket"], "written": 1}
    assert sinks.write_artifacts(str(tmp_path / "art"), {"r.md": "é"})["r.md"]["bytes"] == 2


def test_secret_lines(spark):
    df = spark.createDataFrame([(1, "ok\nx glpat-" + "a" * 20 + "\npassword = 'abcdefghijklmnop1'"), (2, None)], "id int, text string")
    got = sorted((r.line_no, r.column_no, r.pattern) for r in profile.secret_findings(df, "id").collect())
    assert got == [(2, 3, "gitlab-pat"), (3, 1, "generic-secret-assignment")]


def test_all_secrets_of_a_text(spark):
    """Several of a kind on one line, and matches that span lines, as text.matchAll() over the whole text gives them."""
    key = "sk-" + "a1" * 10
    texts = ["é token=abcdefghijklmnop, token: 'qrstuvwxyzabcdef' end", 'a\n  token:\n "abcdefghijklmnop"\nb', f"{key} {key}\n\n{key}", "-----BEGIN PRIVATE KEY-----\n" * 2, "password =\n\n" + "x" * 15]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expected = []
    for i, text in enumerate(texts):
        for kind, pattern in profile.SECRET_PATTERNS.items():
            for m in re.finditer(pattern, text, re.A):
                line = text.count("\n", 0, m.start())
                expected.append((i, line + 1, m.start() - text.rfind("\n", 0, m.start()), kind, text.split("\n")[line].strip(" ")))
    assert [sum(e[0] == i for e in expected) for i in range(5)] == [2, 1, 3, 2, 0]
    assert sorted(map(tuple, profile.secret_findings(df, "id").collect())) == sorted(expected)


def test_severities_are_bounded(spark):
    rows = [("c", "1", "a", 9.0), ("c", "1", "b", 4.0), ("c", "2", "a", -3.0), ("c", "3", "b", float("nan")), ("c", "4", "a", 2.0), ("c", "4", "a", None), ("c", "4", "b", 2.5)]
    ratings = spark.createDataFrame(rows, "conv_id string, turn_id string, rater string, severity double")
    units = agreement.severity_units(ratings, ratings)
    assert sorted((r.turn_id, r.a, r.b) for r in units.collect()) == [("1", 4, 4), ("2", 0, 0), ("3", 0, 0), ("4", 2, 2.5)]
    assert dict(agreement.severity_units(ratings, ratings.withColumn("severity", F.col("severity").cast("int"))).dtypes)["a"] == "int"


def test_small_functions(spark):
    df = spark.createDataFrame([("ruleVersion", "zh-TW", '{"b":1,"a":{"d":null,"c":[1,2]}}', "漢字ab")], "a string, b string, c string, d string")
    row = df.select(tx.kebab(F.col("a")).alias("k"), tx.language_label(F.col("b")).alias("l"), tx.canonical_json(F.col("c")).alias("j"), tx.cjk_ratio(F.col("d")).alias("r")).first()
    assert tuple(row) == ("rule-version", "zh", '{"a":{"c":[1,2],"d":null},"b":1}', 0.5)


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    spark.conf.set("spark.sql.shuffle.partitions", "1")

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(240)
        return spark.table(name)

    assert run(jobs.distinct_within(stream, "ts", ["event_id"]), "seen").count() == events.select("event_id").distinct().count()
    counted = run(jobs.tumbling_counts(stream, "ts", "event_type"), "counted").agg(F.sum("n")).first()[0]
    assert 0 < counted <= events.count()
    keyed = stream.selectExpr("user_id AS conv_id", "'fact' AS ledger_type", "event_type AS entry_key", "CAST(event_id AS INT) AS turn_idx", "event_id % 5 = 0 AS resolved", "ts")
    assert run(jobs.repeat_ledger(keyed), "ledger").count() == events.count()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
