"""Files of the benchmark and the corpus: splits, manifests, older numberings; and markdown tables as a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "schema_version string, git struct<commit:string,dirty:boolean>, split struct<path:string,sha256:string,case_count:bigint,cases:array<string>>, prompts array<struct<case_id:string,mode:string,sha256:string,chars:bigint>>"


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a split file, whole, so that lines keep their order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).select((F.col("at") + 1).alias("line_no"), "line")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each manifest."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_prompts(manifests: DataFrame) -> DataFrame:
    """(place, case_id, mode, sha256, chars): the prompts that manifests list."""
    return manifests.select(F.posexplode("prompts").alias("place", "p")).select("place", "p.*")


def read_legacy_pcs(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, legacy_pc, valid) of a JSON list of cases with the pcs of an older numbering; a pc has to be a number from 0 on."""
    rows = spark.read.schema("case_id string, rejected_insn_idx string").option("multiLine", True).json(path)
    pc = F.when(F.col("rejected_insn_idx").rlike(r"^\d+$"), F.col("rejected_insn_idx").try_cast("int"))
    return rows.select("case_id", pc.alias("legacy_pc"), (pc.isNotNull() & F.col("case_id").isNotNull()).alias("valid"))


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """(value): a small table's lines in markdown, in the given order: header, rule, a line for each row. For reports."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select(line([cell(c) for c in rows.columns]).alias("value"), F.struct(*order).alias("k"))
    head = [f"| {' | '.join(rows.columns)} |", f"| {' | '.join('---' for _ in rows.columns)} |"]
    gathered = body.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("lines"))
    return gathered.select(F.explode(F.concat(F.array(*map(F.lit, head)), F.col("lines"))).alias("value"))


def ratio_text(part: Column, whole: Column) -> Column:
    """`n/d (p%)`, 0 percent of nothing."""
    return F.format_string("%d/%d (%.1f%%)", part.cast("long"), whole.cast("long"), F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)))
