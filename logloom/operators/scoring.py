"""From a folder of labelled cases to the table of an evaluation: cases joined with what their logs are explained to be, a row for each,
and every metric of diagnostics and of a baseline that only looks for words in the terminal error, in one aggregate over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evaluation as V
from ..sources.harness import ratio_text
from ..sources.logs import read_log_lines, read_yaml
from . import diagnose
from .evaluate import ratio

MANIFEST = "cases array<struct<case_id:string,source_kind:string>>, defaults struct<label:struct<taxonomy_class:string,confidence:string>,capture:struct<verifier_log:string>>"
CASE = "label struct<taxonomy_class:string,error_id:string,fix_type:string,tags:array<string>,root_cause_insn_idx:int,confidence:string>, capture struct<verifier_log:string,terminal_error:string>"
# The classes of the taxonomy, and the name of a log that a case does not name.
CLASSES = ("source_bug", "lowering_artifact", "environment_or_configuration", "verifier_false_positive", "verifier_limit")
LOG = "replay-verifier.log"


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, source_kind, taxonomy, label_error_id, fix_type, tags, root_pc, confidence, terminal_error, log_path) of a folder with
    manifest.yaml and cases/<case_id>/case.yaml. Values that a case lacks come from the manifest's defaults; a case that the manifest
    does not list has no source kind."""
    manifest = read_yaml(spark, f"{root}/manifest.yaml").select(F.from_json("document", MANIFEST).alias("m"))
    listed = manifest.select(F.explode("m.cases").alias("c")).select("c.case_id", "c.source_kind")
    defaults = manifest.select(F.col("m.defaults").alias("d"))  # one row
    found = read_yaml(spark, f"{root}/cases/*/case.yaml").select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.from_json("document", CASE).alias("x"))
    found = found.withColumn("case_id", F.regexp_extract("folder", "([^/]+)$", 1)).crossJoin(F.broadcast(defaults)).join(listed, "case_id", "left")
    log = F.coalesce("x.capture.verifier_log", "d.capture.verifier_log", F.lit(LOG))
    return found.select(
        "case_id", "source_kind", F.coalesce("x.label.taxonomy_class", "d.label.taxonomy_class").alias("taxonomy"), F.coalesce("x.label.error_id", F.lit("")).alias("label_error_id"), "x.label.fix_type", "x.label.tags",
        F.col("x.label.root_cause_insn_idx").alias("root_pc"), F.coalesce("x.label.confidence", "d.label.confidence", F.lit("")).alias("confidence"), F.coalesce("x.capture.terminal_error", F.lit("")).alias("terminal_error"), F.concat("folder", F.lit("/"), log).alias("log_path"),
    )


def evaluation_rows(cases: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Cases with what was found: error_id, failure_class, action, prose_action, pcs, primary_span, related of their diagnostic (log_id is
    the log's path), and baseline_id, baseline_class, baseline_action, baseline_prose by words alone. Cases whose log was not explained
    have the unknown id."""
    d = diagnostics.select(F.col("log_id").alias("log_path"), F.struct("error_id", "failure_class", "next_action", "help", "required", "message", "pc", "path", "source_line", F.size("related").alias("related")).alias("d"))
    rows = cases.join(d, "log_path", "left").withColumn("b", V.dictionary(F.col("terminal_error")))
    failure_class = F.coalesce("d.failure_class", F.lit(V.UNKNOWN[1]))
    own = (F.col("d.help"), F.col("d.required"), F.col("d.message"), failure_class)
    rows = rows.select(
        "case_id", "source_kind", "taxonomy", "label_error_id", V.label_action(F.col("taxonomy"), F.col("fix_type"), F.col("tags")).alias("label_action"), "root_pc", "confidence",
        F.coalesce("d.error_id", F.lit(V.UNKNOWN[0])).alias("error_id"), failure_class.alias("failure_class"), F.lower(V.diagnostic_action(F.col("d.next_action"), *own)).alias("action"), V.prose_action(*own).alias("prose_action"), F.filter(F.array("d.pc"), lambda x: x.isNotNull()).alias("pcs"),
        (F.col("d.path").isNotNull() & F.col("d.source_line").isNotNull()).alias("primary_span"), F.coalesce("d.related", F.lit(0)).alias("related"), F.col("b.error_id").alias("baseline_id"), F.col("b.failure_class").alias("baseline_class"), "terminal_error",
    )
    return rows.withColumn("baseline_action", V.word_action(F.col("terminal_error"), F.col("baseline_class"))).drop("terminal_error")


def _recall(label: str) -> tuple:
    of = F.col("taxonomy") == label
    return of & (F.col("failure_class") == label), of & (F.col("baseline_class") == label), of


def measures() -> dict[str, tuple]:
    """Metric -> (counts for the diagnostic, counts for the baseline, out of): conditions on a row."""
    known = lambda c: F.col(c) != V.UNKNOWN[0]
    every, labelled, placed = F.lit(True), F.col("label_action") != "unspecified", F.col("root_pc").isNotNull()
    within = lambda k: placed & F.exists("pcs", lambda p: F.abs(p - F.col("root_pc")) <= k)
    agrees = lambda a, b: F.col(a) == F.col(b)
    return {
        "known error id": (known("error_id"), known("baseline_id"), every),
        "error-id exact": (agrees("error_id", "label_error_id"), agrees("baseline_id", "label_error_id"), every),
        "taxonomy agreement": (agrees("failure_class", "taxonomy"), agrees("baseline_class", "taxonomy"), every),
        **{f"{c.split('_or_')[0].replace('_', '-')} recall": _recall(c) for c in CLASSES[1:]},
        "primary span emitted": (F.col("primary_span"), F.lit(False), every),
        "related proof spans emitted": (F.col("related") > 0, F.lit(False), every),
        "root pc exact": (within(0), F.lit(False), placed),
        "root pc within 5": (within(5), F.lit(False), placed),
        "next-action exact": (labelled & agrees("action", "label_action"), labelled & agrees("baseline_action", "label_action"), labelled),
        "prose-action exact": (labelled & agrees("prose_action", "label_action"), labelled & agrees("baseline_action", "label_action"), labelled),
    }


def counted(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, place, metric, hits, baseline_hits, total): one pass over the rows, pre-aggregated before the shuffle."""
    by, parts = by or [], measures()
    sums = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"{k}_{j}") for k, three in enumerate(parts.values()) for j, c in enumerate(three)]
    one = rows.groupBy(*by).agg(*sums)
    each = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(m).alias("metric"), F.col(f"{k}_0").alias("hits"), F.col(f"{k}_1").alias("baseline_hits"), F.col(f"{k}_2").alias("total")) for k, m in enumerate(parts)))
    return one.select(*by, F.explode(each).alias("x")).select(*by, "x.*")


def macro_f1(rows: DataFrame, pred: str) -> DataFrame:
    """(f1): the mean over the classes of F1 of `pred` against taxonomy; a class that neither has counts as 0. One row."""
    sides = F.array(F.struct(F.col("taxonomy").alias("c"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    each = rows.select(F.explode(sides).alias("x"), ((F.col("taxonomy") == F.col(pred)).cast("int")).alias("same")).where(F.col("x.c").isin(*CLASSES))
    by_class = each.groupBy("x.c").agg(F.sum("x.g").alias("g"), F.sum("x.p").alias("p"), F.sum(F.col("same") * F.col("x.g")).alias("tp"))
    return by_class.agg(F.coalesce(F.sum(ratio(2.0 * F.col("tp"), F.col("g") + F.col("p"))) / len(CLASSES), F.lit(0.0)).alias("f1"))


def summary(rows: DataFrame) -> DataFrame:
    """(place, metric, diagnostic, baseline) as text, for a report: `hits/total (share)`, and macro-F1 with three digits."""
    table = counted(rows).select("place", "metric", ratio_text(F.col("hits"), F.col("total")).alias("diagnostic"), ratio_text(F.col("baseline_hits"), F.col("total")).alias("baseline"))
    shown = lambda pred, name: macro_f1(rows, pred).select(F.format_string("%.3f", "f1").alias(name))
    f1 = shown("failure_class", "diagnostic").crossJoin(shown("baseline_class", "baseline"))  # one row each
    return table.unionByName(f1.select(F.lit(len(measures())).alias("place"), F.lit("taxonomy macro-F1").alias("metric"), "diagnostic", "baseline"))


def evaluated(spark: SparkSession, root: str) -> DataFrame:
    """The rows of a folder of cases: reads manifest, cases and logs, explains the logs, and joins."""
    cases = read_cases(spark, root)
    lines = read_log_lines(spark, f"{root}/cases/*/*.log")
    wanted = lines.join(cases.select(F.col("log_path").alias("log_id")).distinct(), "log_id", "left_semi")
    return evaluation_rows(cases, diagnose.explained(wanted))
