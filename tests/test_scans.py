"""Directory scans, validation bars, the dataset run, the driver contract."""

import importlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from parley.operators import filtering, validation
from parley.plans import datasets
from parley.plans.risk import Config
from parley.sources import scans


def test_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"decision": "GO", "report": {"risk_status": "Normal"}, "generatedAt": "2026-01-01T00:00:00Z"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "no.txt").write_text("{}")
    good, bad = scans.reports(spark, str(tmp_path))
    assert [(r.id, r.kind, r.decision, r.state) for r in good.select("id", "kind", "decision", "state").collect()] == [("r", "risk", "GO", "Normal")]
    assert [r.id for r in bad.collect()] == ["b"]


def test_artifacts_and_sources(spark, tmp_path):
    at = tmp_path / "art" / "PAIR" / "black_box"
    at.mkdir(parents=True)
    (at / "m1.json").write_text(json.dumps({"jailbreaks": [{"index": 0, "prompt": "p"}, {"index": 1, "prompt": " "}]}))
    (at / "attack-info.json").write_text("{}")
    rows = scans.artifacts(spark, str(tmp_path / "art"), "jailbreaks").collect()
    assert [(r.method, r.attack, r.model, r.place, r.prompt) for r in rows] == [("PAIR", "black_box", "m1", 0, "p")]
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("x\ntoken = 'abcdefghijklmnopq'\n")
    (src / "node_modules" / "b.js").write_text("token = 'abcdefghijklmnopq'")
    (src / "c.bin").write_bytes(b"token = 'abcdefghijklmnopq'\0")
    assert [(r.id.rpartition("/")[2], r.line_no) for r in scans.source_secrets(spark, str(src)).collect()] == [("a.py", 2)]


def test_validation(spark):
    df = spark.createDataFrame([("a", 0.9, 0.95, 0.6, 0.7, 0.8), ("b", 0.9, 0.95, 0.6, None, 0.8), ("c", 0.1, 0.95, 0.6, 0.7, 0.8)], "id string, content_validity double, construct_fit double, criterion_correlation double, kappa double, retest_correlation double")
    assert {r.id: r.readiness for r in validation.readiness(validation.evaluate_stages(df, "id"), "id").collect()} == {"a": "ready", "b": "unknown", "c": "not_ready"}
    assert validation.pilot_errors({"x": 3, "y": 2}, 5) == [] and validation.pilot_errors({"x": -1}, 5) and validation.pilot_errors({"x": 1}, 5)


def test_dataset_run(spark):
    body = "quite enough visible characters number"
    turns = [("T1", "user", body, "trusted", False), ("T2", "assistant", body, "trusted", False)]
    rows = [(i, "a" if i < 4 else "b", "en", [(t, r, f"{x} {i}", s, b) for t, r, x, s, b in turns]) for i in range(8)] + [(9, "b", "en", [])]
    from parley.operators.turns import TURN

    df = spark.createDataFrame(rows, f"conv_id long, dataset string, language string, turns array<{TURN}>")
    out = datasets.run(df, {"a": 1, "b": 2}, 5, filtering.Filter(), Config(deidentify=False))
    assert {r.dataset: (r.kept, r.sampled, r.go) for r in out["summary"].collect()} == {"a": (4, 2, 2), "b": (4, 3, 3)}
    assert out["report"].where(F.col("risk_status") != "Normal").count() == 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_the_training_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "parley.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    for name in [m for m in sys.modules if m.startswith("parley.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    assert len(names) >= 45 and not any(n.startswith("op") and "_" in n and n[2].isdigit() or n == "pipeline" for n in names)


@pytest.mark.parametrize("module", ["bench", "parley.sources.sinks", "parley.sources.synthetic", "parley.streaming.jobs"])
def test_imports(module):
    importlib.import_module(module)
