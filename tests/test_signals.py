"""Whole logs, one for each signal or event that they are about, explained in one go."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import signals as P
from logloom.plans.signal_logs import LOGS

@pytest.fixture(scope="module")
def found(explained_logs):
    return explained_logs.found


def test_each_signal_holds(found):
    missing = {k: (found[k].obligation, found[k].signals) for k in LOGS if k in P.PREDICATES and k not in found[k].signals}
    assert not missing


def test_class_alone(found):
    assert found["none, class only"].signal is None and found["none, class only"].failure_class == "source_bug"
    r = found["malformed"]
    assert r.signals == [] and r.events == [] and r.error_id == "E006"


def test_a_signal_speaks_by_rank_and_class(found):
    r = found["PacketAccessWithoutBoundsProof"]
    assert (r.signal, r.error_id, r.failure_class, r.next_action) == ("PacketAccessWithoutBoundsProof", "E001", "source_bug", "Bounds")
    assert r.required == "prove R2 has packet range at least 21 bytes before this access; verifier currently has range 0"
    assert [(e.role, e.evidence) for e in r.events] == [("established", "source"), ("lost", "state"), ("rejected", "terminal")]
    assert [(s.line, s.strength) for s in r.related] == [(10, 0)] and r.span_confidence == "exact_pc"
    assert "10 | if (data + 14 > data_end)" in r.text and "12 | x = data[20];\n   | ^^^^^^^^^^^^^ rejected here: verifier needs R2" in r.text
    r = found["BtfFuncInfoMissing"]
    assert (r.signal, r.error_id, r.diagnostic_kind) == ("BtfFuncInfoMissing", "E021", "supported")


def test_every_signal_has_one_row_and_one_place():
    names = [r[0] for r in P.SIGNALS]
    assert len(names) == len(set(names)) == 73 and set(names) == set(P.PREDICATES) and sorted(names) == sorted((*P.ORDER, *P.FALLBACKS))


@pytest.mark.parametrize(("signal", "base", "may"), [("WideStackAlignment", "source_bug", True), ("WideStackAlignment", "verifier_limit", False), ("IrqFlagStateMismatch", "unsupported_verifier_message", True), ("ContextFieldUnavailable", "source_bug", False), ("ExceptionThrowWithLiveReference", "environment_or_configuration", True)])
def test_overrides(spark, signal, base, may):
    row = P.dimension(spark).where(F.col("signal") == signal).select(P.can_override(F.col("signal"), F.lit(base), F.col("replaces_unsupported")).alias("x")).first()
    assert row.x is may
