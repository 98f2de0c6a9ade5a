"""Functions of corpora, evaluation and programs that no query reaches, against values worked out by hand."""

import hashlib

from pyspark.sql import functions as F

from logloom.functions import sources as T
from logloom.operators import cfg, corpus, evaluate, harness
from logloom.sources import logs as src


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_corpus(spark):
    logs = spark.createDataFrame([("a", "trace_rich", 2), ("a", "empty", 1), ("b", None, 3), ("b", "empty", 2), ("c", "message_only", 9), ("c", "message_only", 8)], "case_id string, quality string, priority int")
    assert rows(corpus.better_log(logs)) == [("a", "trace_rich", 2), ("b", "empty", 2), ("c", "message_only", 8)]
    cases = spark.createDataFrame([("a", "e", "e", 1, None), ("b", "e", "f", 2, 2), ("c", None, None, None, None)], "case_id string, terminal_error string, capture_terminal_error string, rejected_pc int, capture_rejected_pc int")
    assert rows(corpus.capture_mismatches(cases, ("terminal_error", "rejected_pc"))) == [("a", "rejected_pc"), ("b", "terminal_error")]
    manifests = spark.createDataFrame([(1, "1", "x", ["a"]), (2, "", None, ["a"]), (3, "1", "x", None)], "manifest_id int, schema_version string, corpus string, cases array<string>")
    assert rows(corpus.manifest_violations(manifests)) == [(2, "corpus"), (2, "schema_version"), (3, "cases")]


def test_evaluation(spark):
    sample = spark.createDataFrame([("exact", "near"), ("exact", "miss"), ("miss", "near")], "proof string, root string")
    assert rows(evaluate.sample_audit(sample, ["proof", "root"])) == [("proof", "exact", 2), ("proof", "miss", 1), ("root", "miss", 1), ("root", "near", 2)]
    cases = spark.createDataFrame([("a", 2, 1, 0, None), ("b", None, None, None, "no object"), ("c", 1, 0, 1, "x")], "case_id string, programs int, attached int, ambiguous int, error string")
    totals, issues = evaluate.object_coverage(cases, issues=1)
    assert rows(totals) == [(3, 3, 1, 1, 2)] and rows(issues) == [("b", "no object")]
    assert rows(evaluate.object_coverage(cases.limit(0))[0]) == [(0, 0, 0, 0, 0)]


def test_harness(spark):
    one = spark.createDataFrame([("p", None), ("p", "why")], "p string, c string").select(harness.with_retry(F.col("p"), F.col("c")).alias("x"))
    assert rows(one) == [("p",), ("p\n\nRetry context:\nwhy\n",)]
    prompts = "case_id string, mode string, sha256 string, chars int"
    wanted = spark.createDataFrame([("a", "raw", "1", 3), ("b", "raw", "2", 3), ("c", "raw", "3", 3)], prompts)
    listed = spark.createDataFrame([("a", "raw", "1", 3), ("b", "raw", "2", 4), ("d", "raw", "3", 3)], prompts)
    assert rows(harness.manifest_problems(wanted, listed)) == [("b", "raw", "different"), ("c", "raw", "missing"), ("d", "raw", "extra")]
    split = spark.createDataFrame([(2, "y"), (1, "x"), (3, "y")], "place int, case_id string")
    assert rows(harness.split_metadata(split)) == [(3, hashlib.sha256(b"x\ny\ny").hexdigest())]
    results = spark.createDataFrame([("a", "raw", "fail"), ("a", "raw", "pass"), ("a", "diag", "fail"), ("b", "raw", "fail")], "case_id string, mode string, status string")
    assert rows(harness.paired_results(results, ("raw", "diag")).na.fill(-1)) == [("a", 1, 0), ("b", 0, -1)]
    kinds = spark.createDataFrame([("a", ["x", "y"]), ("b", None), ("c", [])], "case_id string, kinds array<string>")
    assert rows(harness.oracle_kinds(kinds, ("d",))) == [("a", "x"), ("a", "y"), ("b", "d")]


def test_programs(spark):
    bindings = spark.createDataFrame([("p", 4, 7, 1), ("p", 2, 7, 0), ("p", 9, 8, 2), ("q", 1, 7, 5)], "program string, pc int, fd int, map_index int")
    assert rows(cfg.map_of_immediate(bindings)) == [("p", 7, 0), ("p", 8, 2), ("q", 7, 5)]
    edges = spark.createDataFrame([("p", 0, 1, "taken"), ("p", 2, 1, "jump"), ("p", 0, 2, "fallthrough"), ("p", 2, 5, "callee"), ("p", 2, 3, "return")], "program string, src int, dst int, kind string")
    assert rows(cfg.entry_sites(edges)) == [("p", 1), ("p", 2)]


def test_sources(spark):
    assert rows(src.one_log(spark, "x\ny")) == [("-", "x\ny")]
    texts = [("if (i < 8 && n < 16)", "i", 8), ("if (i < 8 && i + k < 4)", "i", 4), ("if (n < 16)", "i", None), ("if (i == 8)", "i", None)]
    df = spark.createDataFrame(texts, "t string, n string, w int")
    assert all(r.x == r.w for r in df.select("w", T.upper_bound(F.col("t"), F.col("n")).alias("x")).collect())
