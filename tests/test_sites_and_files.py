"""Sites in blocks, and the benchmark's files."""

import json

from pyspark.sql import functions as F

from logloom.operators import audit, cfg, harness
from logloom.sources import harness as files


def test_sites(spark):
    rows = spark.createDataFrame([("p", 0, 0, 0x18), ("p", 0, 1, 0xB7), ("p", 1, 0, 0x95)], "program string, block int, index int, code int").withColumn("insn", F.struct("code"))
    assert [r.current_pc for r in cfg.site_pcs(rows).orderBy("block", "index").collect()] == [0, 2, 3]
    moved = cfg.moved_pcs(rows.withColumn("pc", F.col("block") * 10 + F.col("index")))
    assert sorted((r.old_pc, r.new_pc) for r in moved.collect()) == [(0, 0), (1, 2), (10, 3)]
    records = spark.createDataFrame([("p", 0), ("p", 10), ("p", 99)], "program string, old_pc int")
    assert sorted((r.old_pc, r.new_pc, r.problem) for r in cfg.remapped(records, moved).collect()) == [(0, 0, None), (10, 3, None), (99, None, "gone")]
    tables = spark.createDataFrame([("p", "a", 16, 8), ("p", "b", 17, 8), ("p", "c", 8, 0)], "program string, name string, n_bytes int, record_size int")
    assert sorted(r.name for r in cfg.sized_records(tables).collect()) == ["b", "c"]
    placed = spark.createDataFrame([("p", 0, pc) for pc in (0, 2, 3, 4)] + [("p", 1, 5)], "program string, frame int, pc int")
    anchors = spark.createDataFrame([("p", 0, 3)], "program string, frame int, anchor int")
    assert sorted((r.pc, r.distance) for r in cfg.around(placed, anchors, 1, 5).collect()) == [(2, -1), (3, 0), (4, 1)]
    assert sorted((r.pc, r["index"]) for r in cfg.sites_of(spark.createDataFrame([("p", 0, 0), ("p", 2, 0), ("p", 3, 1)], "program string, pc int, block int")).collect()) == [(0, 0), (2, 1), (3, 0)]
    ends = spark.createDataFrame([("p", 0, "branch", 7)], "program string, block int, terminator string, last int")
    profile = spark.createDataFrame([("p", 7, 1, 3), ("p", 8, 1, 1)], "program string, pc int, taken long, not_taken long")
    assert sorted((r.pc, r.rate, r.problem) for r in cfg.with_profile(ends, profile).collect()) == [(7, 0.25, None), (8, 0.5, "no branch")]
    live = spark.createDataFrame([(4, 1), (4, 0)], "node int, var int")
    assert [r.regs for r in cfg.live_behind(live, spark.createDataFrame([("w", 4)], "window_id string, node int")).collect()] == [[0, 1]]


def test_agreement(spark):
    rows = [("p", 1, 0, "scalar", 5, "insn_delta"), ("p", 1, 0, "scalar", 5, "insn_delta"), ("p", 1, 1, "pkt", None, "insn_delta"), ("p", 1, 1, "scalar", 3, "pc_full"), ("p", 2, 0, "scalar", 1, "insn_delta"), ("p", 2, 0, "scalar", 2, "insn_delta")]
    df = spark.createDataFrame(rows, "program string, pc int, reg int, reg_type string, exact int, state_kind string")
    assert sorted((r.pc, r.reg, r.kind) for r in cfg.known_kinds(df).collect()) == [(1, 0, "scalar"), (1, 1, None), (2, 0, "scalar")]
    assert sorted((r.pc, r.reg, r.value) for r in cfg.known_constants(df).collect()) == [(1, 0, 5)]


def test_files(spark, tmp_path):
    (tmp_path / "main.txt").write_text("# all\na\nb # second\n\nc/d\n")
    entries = harness.split_entries(files.read_split(spark, str(tmp_path / "main.txt")))
    assert [(r.case_id, r.valid) for r in entries.orderBy("place").collect()] == [("a", True), ("b", True), ("c/d", False)]
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1", "prompts": [{"case_id": "a", "mode": "raw", "sha256": "x", "chars": 3}, {"case_id": "a", "mode": "raw", "sha256": "y", "chars": 4}]}))
    prompts = files.manifest_prompts(files.read_manifest(spark, str(tmp_path / "m.json")))
    assert [(r.case_id, r.row.sha256) for r in harness.prompt_index(prompts).collect()] == [("a", "y")]
    (tmp_path / "old.json").write_text(json.dumps([{"case_id": "a", "rejected_insn_idx": 7}, {"case_id": "b", "rejected_insn_idx": "x"}]))
    assert sorted(map(tuple, files.read_legacy_pcs(spark, str(tmp_path / "old.json")).collect())) == [("a", 7, True), ("b", None, False)]
    table = spark.createDataFrame([("b", 2), ("a", None)], "name string, n int")
    assert [r.value for r in files.markdown(table, ["name"]).collect()] == ["| name | n |", "| --- | --- |", "| a |  |", "| b | 2 |"]
    one = spark.range(1).select(files.ratio_text(F.lit(1), F.lit(3)).alias("a"), files.ratio_text(F.lit(0), F.lit(0)).alias("b")).first()
    assert tuple(one) == ("1/3 (33.3%)", "0/0 (0.0%)")


def test_order_across_stretches(spark):
    rows = spark.createDataFrame([("x", p, k) for p, k in ((0, 5), (1, 6), (12, 6), (13, 9), (40, 8))], "part string, place long, k int")
    for width in (1, 10, 1000):
        assert sorted((r.place, r.before) for r in audit.out_of_order(rows, "part", "place", "k", width).collect()) == [(12, 6), (40, 9)]
