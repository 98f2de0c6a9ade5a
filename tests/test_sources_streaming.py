import datetime
import json
import struct

import pytest
from pyspark.sql import functions as F

from logloom.operators import diagnose, logs
from logloom.sources import logs as src
from logloom.streaming import rejections as R


def test_files_to_diagnostics_and_back(spark, tmp_path):
    for i, end in enumerate(["R1 !read_ok", "Unreleased reference id=2 alloc_insn=5"]):
        (tmp_path / f"{i}.log").write_text(f"0: (95) exit\n{end}\nprocessed 1 insns\n")
    found = diagnose.diagnostics(logs.region(logs.lines(src.read_logs(spark, str(tmp_path)))))
    assert sorted(r.error_id for r in found.collect()) == ["E003", "E004"]
    src.write_text(found, str(tmp_path / "text"))
    src.write_json(found, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert any("error[E003]" in r.value for r in spark.read.text(str(tmp_path / "text")).collect())
    by_line = src.read_log_lines(spark, str(tmp_path / "*.log"))
    assert sorted((r.line_no, r.line) for r in by_line.where("log_id like '%0.log'").collect())[1] == (2, "R1 !read_ok")


def test_instruction_bytes(spark):
    data = struct.pack("<BBhi", 0x61, 0x2A, -8, -1) + struct.pack("<BBhi", 0x95, 0, 0, 70000)
    df = spark.createDataFrame([(bytearray(data),), (bytearray(data[:9]),), (bytearray(b""),)], "d binary").select(F.transform(src.instruction_bytes(F.col("d")), src.decoded).alias("i"))
    whole, broken, none = (r.i for r in df.collect())
    assert [tuple(x) for x in whole] == [(0x61, 10, 2, -8, -1), (0x95, 0, 0, 0, 70000)] and broken is None and none == []


def test_reports(spark, tmp_path):
    ok = {"returncode": 0}
    reports = [
        {"compile": {"returncode": 1}, "passed": False}, {"compile": ok, "load": {"returncode": 1}, "passed": False}, {"compile": ok, "load": ok, "expect_reject": True, "passed": False},
        {"compile": ok, "load": ok, "functional": [{"name": "a", "passed": False}], "passed": False}, {"compile": ok, "load": ok, "functional": [{"name": "a", "passed": True}], "source_semantics": [{"name": "x", "passed": False}], "passed": False}, {"compile": ok, "load": ok, "passed": True},
    ]
    for i, r in enumerate(reports):
        (tmp_path / f"{i}.json").write_text(json.dumps(r))
    rows = src.read_reports(spark, str(tmp_path)).select("path", F.struct("*").alias("report")).select("path", src.failure_stage().alias("s")).orderBy("path").collect()
    assert [r.s for r in rows] == ["compile", "load", "load", "functional", "auxiliary", None]
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "summary.json").write_text(json.dumps({"mode": "raw", "total": 2, "passed": 1, "results": [{"case": "a", "status": "pass"}, {"case": "b", "status": "fail", "failure_stage": "load"}]}))
    assert {(r.case, r.failure_stage) for r in src.read_summaries(spark, str(tmp_path / "run")).collect()} == {("a", None), ("b", "load")}


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("case_id: x\nlabel: {error_id: E001}\n")
    assert [r.document for r in src.read_yaml(spark, f"{tmp_path}/*.yaml").collect()] == ['{"case_id": "x", "label": {"error_id": "E001"}}']
    r = src.read_yaml(spark, f"{tmp_path}/*.yaml").select(F.from_json("document", "case_id string, label struct<error_id: string>").alias("d")).first().d
    assert (r.case_id, r.label.error_id) == ("x", "E001")


def test_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    rows = [("a", at(1), "5: (95) exit"), ("a", at(2), "\x1b[31mR1 !read_ok\x1b[0m"), ("b", at(3), "R2 !read_ok"), ("b", at(14), "unknown func x#1"), ("a", at(59), "R1 !read_ok")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "log_id string, ts timestamp, line string").write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
    stream = spark.readStream.schema("log_id string, ts timestamp, line string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = R.counts(R.rejections(stream)).writeStream.format("memory").queryName("rejected").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start.minute, r.error_id): r.n for r in spark.sql("select * from rejected").collect()}
    assert got == {(0, "E003"): 2, (10, "E009"): 1, (50, "E003"): 1}
    batch = spark.createDataFrame(rows, "log_id string, ts timestamp, line string")
    assert {(r.log_id, r.error_id, r.n) for r in R.last_per_log(R.rejections(batch), "20 minutes").collect()} == {("a", "E003", 1), ("b", "E009", 2)}
