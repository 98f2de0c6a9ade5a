"""Reading logs, reports and case files; writing diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPORT = "source string, expect_reject boolean, compile struct<returncode: int, stdout: string, stderr: string>, load struct<returncode: int, stdout: string, stderr: string>, source_semantics array<struct<kind: string, name: string, passed: boolean>>, functional array<struct<name: string, expected_retval: long, actual_retval: long, passed: boolean>>, passed boolean"
SUMMARY = "mode string, total int, passed int, results array<struct<case: string, status: string, failure_stage: string, mode: string, model: string, attempt: int, prompt_sha256: string, prompt_chars: long, source_chars: long, diagnostic_chars: long>>"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, text): a row for each file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("text"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, line) of files of any size: Spark splits them into blocks, lines are numbered in each, and counts of lines by
    block, a small table, say where each block's numbers start."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    counts = raw.groupBy("log_id", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("log_id", "block", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("log_id", "block").orderBy("at"))
    return raw.withColumn("n", within).join(starts, ["log_id", "block"]).select("log_id", (F.col("start") + F.col("n")).cast("int").alias("line_no"), "line")


def one_log(spark: SparkSession, text: str, log_id: str = "-") -> DataFrame:
    """A log that is at hand as text, such as standard input."""
    return spark.createDataFrame([(log_id, text)], "log_id string, text string")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each result of each run."""
    runs = spark.read.schema(SUMMARY).option("multiLine", True).json(path)
    return runs.select(F.col("mode").alias("run_mode"), "total", "passed", F.explode("results").alias("r")).select("run_mode", "total", "passed", "r.*")


def failure_stage(report: str = "report") -> Column:
    """The first stage of a report that failed; null if all passed."""
    r = F.col(report)
    failed = lambda c: F.coalesce(F.exists(c, lambda x: ~x["passed"]), F.lit(False))
    wrong_load = F.when(F.coalesce(r["expect_reject"], F.lit(False)), r["load"]["returncode"] == 0).otherwise(r["load"]["returncode"] != 0)
    return F.when(r["compile"]["returncode"] != 0, "compile").when(wrong_load, "load").when(failed(r["functional"]), "functional").when(failed(r["source_semantics"]), "auxiliary").when(~r["passed"], "auxiliary")


def instruction_bytes(data: Column) -> Column:
    """The eight-byte instructions of a section; null if its length is no multiple of eight."""
    n = F.length(data)
    at = F.when((n % 8 == 0) & (n > 0), F.sequence(F.lit(1), n - 7, F.lit(8)))
    return F.when(n == 0, F.array().cast("array<binary>")).otherwise(F.transform(at, lambda i: F.substring(data, i, F.lit(8))))


def decoded(instruction: Column) -> Column:
    """(code, dst, src, off, imm) of eight little-endian bytes, by arithmetic on their hexadecimal digits."""
    h = F.hex(instruction)
    byte = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("long")
    wrap = lambda x, bits: F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x)
    return F.struct(byte(0).cast("int").alias("code"), (byte(1) % 16).cast("int").alias("dst"), F.floor(byte(1) / 16).cast("int").alias("src"), wrap(byte(2) + 256 * byte(3), 16).cast("int").alias("off"), wrap(byte(4) + 256 * byte(5) + 65536 * byte(6) + 16777216 * byte(7), 32).cast("int").alias("imm"))


def write_text(diagnostics: DataFrame, path: str) -> None:
    diagnostics.select("text").write.mode("errorifexists").text(path)


def write_json(diagnostics: DataFrame, path: str) -> None:
    diagnostics.write.mode("errorifexists").json(path)


# ---- YAML ----


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, document as JSON) of each file, read by Spark from any store it knows; needs PyYAML on the executors. Files that hold no
    mapping are errors."""

    def parse(batches):
        import json

        import pyarrow as pa
        import yaml

        for batch in batches:
            out = []
            for name, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                document = yaml.safe_load(text)
                if not isinstance(document, dict):
                    raise ValueError(f"{name} is no mapping")
                out.append(json.dumps(document, default=str))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], ["path", "document"])

    return read_logs(spark, path).withColumnRenamed("log_id", "path").mapInArrow(parse, "path string, document string")
