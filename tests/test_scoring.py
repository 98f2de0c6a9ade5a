"""A folder of cases goes in, the table of its evaluation comes out."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import diagnose, scoring
from logloom.sources.harness import markdown

LABELS = {
    "PacketAccessWithoutBoundsProof": {"taxonomy_class": "source_bug", "error_id": "E001", "root_cause_insn_idx": 1, "tags": ["stack_bounds"]},
    "BtfFuncInfoMissing": {"taxonomy_class": "environment_or_configuration", "error_id": "E021", "root_cause_insn_idx": 4},
    "WideStackAlignment": {"taxonomy_class": "lowering_artifact", "error_id": "E099"},
    "LoopBackEdgeStateRepeats": {"taxonomy_class": "verifier_limit", "error_id": "E018", "root_cause_insn_idx": 50},
    "MapValueWideAccess": {"error_id": "E005"},
}


@pytest.fixture(scope="module")
def rows(spark, explained_logs):
    pytest.importorskip("yaml")
    at = {name: explained_logs.cases[name] for name in LABELS}
    manifest = {"cases": [{"case_id": c, "source_kind": "kernel" if k else "forum"} for k, c in enumerate(at.values()) if k < 4] + [{"case_id": "none", "source_kind": "x"}], "defaults": {"label": {"taxonomy_class": "lowering_artifact", "confidence": "low"}}}
    (explained_logs.root / "manifest.yaml").write_text(json.dumps(manifest))
    for name, label in LABELS.items():
        (explained_logs.root / "cases" / at[name] / "case.yaml").write_text(json.dumps({"label": label, "capture": {"terminal_error": "invalid access to packet, off=20" if name.startswith("Packet") else ""}}))
    (explained_logs.root / "cases" / "empty").mkdir()
    (explained_logs.root / "cases" / "empty" / "case.yaml").write_text(json.dumps({"label": {"taxonomy_class": "source_bug", "root_cause_insn_idx": 0}}))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(diagnose, "explained", lambda lines: explained_logs.frame.join(lines.select("log_id").distinct(), "log_id", "left_semi"))
        frame = scoring.evaluated(spark, str(explained_logs.root))
        return frame, {r.case_id: r for r in frame.collect()}, at


def test_rows(rows):
    _, found, at = rows
    assert set(found) == {*at.values(), "empty"}
    r = found[at["PacketAccessWithoutBoundsProof"]]
    assert (r.source_kind, r.error_id, r.failure_class, r.action, r.label_action, r.pcs, r.primary_span, r.related) == ("forum", "E001", "source_bug", "bounds", "bounds", [1], True, 1)
    assert r.baseline_id != "UNKNOWN" and r.baseline_class == "source_bug"
    r = found[at["MapValueWideAccess"]]
    assert (r.source_kind, r.taxonomy, r.confidence, r.failure_class) == (None, "lowering_artifact", "low", "lowering_artifact")
    r = found["empty"]  # without a log
    assert (r.error_id, r.failure_class, r.pcs, r.primary_span, r.related) == ("UNKNOWN", "source_bug", [], False, 0)


def test_summary(rows):
    frame, found, _ = rows
    table = {r.metric: (r.diagnostic, r.baseline) for r in scoring.summary(frame).collect()}
    assert table["known error id"] == ("5/6 (83.3%)", "1/6 (16.7%)") and table["error-id exact"][0] == "4/6 (66.7%)"
    assert table["lowering-artifact recall"][0] == "2/2 (100.0%)" and table["environment recall"][0] == "1/1 (100.0%)" and table["verifier-false-positive recall"] == ("0/0 (0.0%)", "0/0 (0.0%)")
    assert table["root pc exact"][0] == "1/4 (25.0%)" and table["root pc within 5"][0] == "2/4 (50.0%)" and table["related proof spans emitted"][0] == "1/6 (16.7%)"
    pairs = [(r.taxonomy, r.failure_class) for r in found.values()]
    f1 = []
    for c in scoring.CLASSES:
        tp, g, p = sum(a == b == c for a, b in pairs), sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
        f1.append(2 * tp / (g + p) if g + p else 0)
    assert table["taxonomy macro-F1"][0] == f"{sum(f1) / 5:.3f}"
    lines = [r.value for r in markdown(scoring.summary(frame), ["place"]).collect()]
    assert lines[0] == "| place | metric | diagnostic | baseline |" and lines[2].startswith("| 0 | known error id | 5/6") and len(lines) == 2 + len(scoring.measures()) + 1


def test_nothing_to_evaluate(rows):
    none = rows[0].where(F.lit(False))
    assert {r.diagnostic for r in scoring.summary(none).collect()} == {"0/0 (0.0%)", "0.000"}
