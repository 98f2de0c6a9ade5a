"""Checks of solutions' sources, and what tests with oracles of their own say that they cover."""

from logloom.operators import harness


def test_source_checks(spark):
    sources = spark.createDataFrame([(1, "a", "int f() { bpf_loop(3); } // bpf_unroll"), (2, "a", "/* bpf_loop( */ int g();\n#pragma unroll"), (3, "a", None), (4, "b", "x"), (5, "none", "x")], "source_id long, case_id string, text string")
    predicates = spark.createDataFrame([("a", "uses a loop", True, r"\bbpf_loop\("), ("a", "does not unroll", False, "unroll"), ("b", "broken", True, None)], "case_id string, name string, wanted boolean, pattern string")
    got = {(r.source_id, r.name): (r.passed, r.error) for r in harness.source_checks(sources, predicates).collect()}
    assert got == {
        (1, "uses a loop"): (True, None), (1, "does not unroll"): (True, None), (2, "uses a loop"): (False, None), (2, "does not unroll"): (False, None),
        (3, "uses a loop"): (False, "cannot read the source"), (3, "does not unroll"): (False, "cannot read the source"), (4, "broken"): (False, "no pattern"),
    }
    assert harness.source_checks(sources.limit(0), predicates).collect() == []


WHOLE = '''
# CUSTOM_ORACLE_COVERAGE = {}
CUSTOM_ORACLE_COVERAGE: dict = {
    "expected_reject_substrings": ["a, b", 'c"]'],
    "functional_tests": [("x", 1), ("y", 2), ("z", [3, 4])],
    "required_success_substrings": [],
    "required_success_predicates": (
        "one",
        "two",
    ),
}
EXPECTED_REJECT_SUBSTRINGS = ["ignored"]
'''


def test_oracle_coverage(spark):
    texts = {
        "whole": (WHOLE, (2, 3, 0, 2)), "fallback": ("EXPECTED_REJECT_SUBSTRINGS: list[str] = [\n  'a',\n  'b, c',\n  'd',\n]\n", (3, None, None, None)), "none": ("run_case()", (None,) * 4),
        "partly": ("CUSTOM_ORACLE_COVERAGE = {\n  'functional_tests': ['t'],\n}\nEXPECTED_REJECT_SUBSTRINGS = ('e', 'f')\n", (2, 1, None, None)),
    }
    got = {r[0]: tuple(r[1:]) for r in harness.oracle_coverage(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "case_id string, text string")).collect()}
    assert got == {k: w for k, (_, w) in texts.items()}
