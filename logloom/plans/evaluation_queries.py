"""Queries over evaluation rows, runs, manifests and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, evaluate
from . import projections as P


def confusion_matrix(spark, d):
    return evaluate.confusion(P.eval_rows(spark, d))


def class_scores(spark, d):
    out = evaluate.per_class(spark, P.eval_rows(spark, d), P.CLASSES)
    return out.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def macro_f1(spark, d):
    rows = P.eval_rows(spark, d)
    scores = evaluate.per_class(spark, rows, P.CLASSES).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return scores.crossJoin(rows.agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n")))


def action_coverage(spark, d):
    rows = P.eval_rows(spark, d)
    n, named, right = F.count("*"), F.count("pred_action"), F.count_if(F.col("pred_action") == F.col("gold_action"))
    return rows.groupBy("stratum").agg(n.alias("n"), named.alias("named"), right.alias("right"), F.round(evaluate.ratio(named, n), 6).alias("coverage"), F.round(evaluate.ratio(right, named), 6).alias("precision"))


def latency_percentiles(spark, d):
    out = evaluate.percentiles(P.eval_rows(spark, d), "duration_ms", 0.5, 0.95)
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "max")))


def root_within_k(spark, d):
    """How often a root cause's pc is among the predicted ones, exactly, within five and within ten."""
    rows = P.eval_rows(spark, d).where("root_pc is not null")
    near = F.array_min(F.transform("pcs", lambda p: F.abs(p - F.col("root_pc"))))
    return rows.withColumn("near", near).groupBy("lang").agg(F.count("*").alias("n"), *(F.count_if(F.col("near") <= k).alias(f"within_{k}") for k in (0, 5, 10)))


def stratified_sample(spark, d):
    return evaluate.stratified_sample(P.eval_rows(spark, d), "stratum", "case_id", 5, "7").select("stratum", "case_id", "gold")


def score_histograms(spark, d):
    rows = P.eval_rows(spark, d).withColumn("bucket", F.floor(F.least(F.col("duration_ms"), F.lit(999.0)) / 50).cast("long"))
    return rows.groupBy("gold", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("right"))


def stratified_rollup(spark, d):
    rows = P.eval_rows(spark, d).rollup("lang", "gold").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("right"))
    return rows.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("gold", F.lit("all")).alias("gold"), "n", "right")


def duplicate_ids(spark, d):
    return audit.duplicates(P.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_texts(spark, d):
    found = P.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return found.where("n > 1")


def defaults_merge(spark, d):
    nations = P.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(0.0).alias("acctbal"), F.col("n_name").alias("segment"))
    rows = P.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.round("c_acctbal", 2)).alias("acctbal"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return audit.with_defaults(rows, nations, ["k"], ["acctbal", "segment"])


def required_field_violations(spark, d):
    t = F.col("text")
    return audit.violations(P.table(spark, d, "documents"), "doc_id", {"lang is known": F.col("lang").isin("en", "de"), "text is long enough": F.length(t) >= 200, "length is right": F.col("n_chars") == F.length(t), "source is early": F.expr("substring(source, 4)").try_cast("int") < 15})


def split_order_check(spark, d):
    return audit.out_of_order(P.table(spark, d, "orders").select(F.col("o_orderpriority").alias("part"), "o_orderkey", F.round("o_totalprice", 2).alias("price")), "part", "o_orderkey", "price").select("part", "o_orderkey", "price", "before")


def prompt_manifest_hash(spark, d):
    """A digest of each conversation's turns in order, and of what they are made of."""
    rows = P.table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("h"), F.length("text").alias("chars"))
    return rows.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda x: x["h"]), ","), 256).alias("sha256"), F.sum("chars").alias("chars"))


def manifest_full_diff(spark, d):
    a = P.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("v")).where("k % 7 <> 0")
    b = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.min("o_orderkey") % 5).alias("v"))
    return audit.difference(a, b, ["k"], ["v"])


def paired_mode_pivot(spark, d):
    wide = evaluate.paired(P.runs(spark, d), ["case_id"], "mode", "status", ["raw", "diagnostic"])
    return wide.groupBy("raw", "diagnostic").agg(F.count("*").alias("n"))


def failure_stage_case(spark, d):
    rows = P.runs(spark, d)
    return rows.groupBy("mode", F.coalesce("stage", F.lit("none")).alias("stage")).agg(F.count("*").alias("n"), F.max("prompt_chars").alias("longest_prompt"), F.sum("attempt").alias("attempts"))


def pass_rates(spark, d):
    rows = P.runs(spark, d)
    return rows.groupBy("mode", "attempt").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pass").alias("passed"), F.round(100 * evaluate.ratio(F.count_if(F.col("status") == "pass"), F.count("*")), 4).alias("percent"))


def prompt_leak_scan(spark, d):
    return audit.leaks(P.table(spark, d, "documents").select("doc_id", "text"), P.table(spark, d, "benchmark").select("item_id", "text"), "doc_id", "item_id")


_C = ", ".join(f"('{c}')" for c in P.CLASSES)
_SCORES = f"""scores AS (
  SELECT label, tp, p - tp AS fp, g - tp AS fn, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS pr, CASE WHEN g > 0 THEN tp / g ELSE 0.0 END AS re FROM (
    SELECT label, (SELECT count(*) FROM eval_rows WHERE gold = label) AS g, (SELECT count(*) FROM eval_rows WHERE pred = label) AS p, (SELECT count(*) FROM eval_rows WHERE gold = label AND pred = label) AS tp FROM (VALUES {_C}) c(label))
), scored AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f FROM scores)"""
_RUN_SQL = """runs8 AS (
  SELECT DISTINCT id, array_to_string(list_slice(ws, i, i + 7), ' ') AS run FROM (
    SELECT id, ws, unnest(range(1, len(ws) - 6)) AS i FROM (SELECT {0} AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM {1}) WHERE len(ws) >= 8)
)"""

QUERIES = {
    "confusion_matrix": (confusion_matrix, P.sql(P.EVAL_ROWS, query="SELECT gold, pred, count(*) AS n FROM eval_rows GROUP BY 1, 2")),
    "class_scores": (class_scores, P.sql(P.EVAL_ROWS, _SCORES, query="SELECT label, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM scored")),
    "macro_f1": (macro_f1, P.sql(P.EVAL_ROWS, _SCORES, query="SELECT (SELECT round(avg(f), 6) FROM scored) AS macro_f1, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM eval_rows")),
    "action_coverage": (action_coverage, P.sql(P.EVAL_ROWS, query="""SELECT stratum, n, named, "right", round(named / n, 6) AS coverage, CASE WHEN named > 0 THEN round("right" / named, 6) ELSE 0.0 END AS precision FROM (SELECT stratum, count(*) AS n, count(pred_action) AS named, count(*) FILTER (WHERE pred_action = gold_action) AS "right" FROM eval_rows GROUP BY 1)""")),
    "latency_percentiles": (latency_percentiles, P.sql(P.EVAL_ROWS, query="SELECT count(*) AS n, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 6) AS p95, round(max(CAST(duration_ms AS DOUBLE)), 6) AS max FROM eval_rows")),
    "root_within_k": (root_within_k, P.sql(P.EVAL_ROWS, query="SELECT lang, count(*) AS n, count(*) FILTER (WHERE near <= 0) AS within_0, count(*) FILTER (WHERE near <= 5) AS within_5, count(*) FILTER (WHERE near <= 10) AS within_10 FROM (SELECT lang, least(abs(pcs[1] - root_pc), abs(pcs[2] - root_pc)) AS near FROM eval_rows WHERE root_pc IS NOT NULL) GROUP BY 1")),
    "stratified_sample": (stratified_sample, P.sql(P.EVAL_ROWS, query="SELECT stratum, case_id, gold FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || case_id), case_id) AS k FROM eval_rows) WHERE k <= 5")),
    "score_histograms": (score_histograms, P.sql(P.EVAL_ROWS, query="""SELECT gold, CAST(floor(least(CAST(duration_ms AS DOUBLE), 999.0) / 50) AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS "right" FROM eval_rows GROUP BY 1, 2""")),
    "stratified_rollup": (stratified_rollup, P.sql(P.EVAL_ROWS, query="""SELECT coalesce(lang, 'all') AS lang, coalesce(gold, 'all') AS gold, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS "right" FROM eval_rows GROUP BY ROLLUP (lang, gold)""")),
    "duplicate_ids": (duplicate_ids, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "duplicate_texts": (duplicate_texts, "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "defaults_merge": (defaults_merge, "SELECT c_custkey, c_nationkey AS k, coalesce(CASE WHEN c_acctbal >= 0 THEN round(c_acctbal, 2) END, CASE WHEN n_nationkey IS NOT NULL THEN 0.0 END) AS acctbal, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, n_name) AS segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "required_field_violations": (required_field_violations, """SELECT doc_id, 'lang is known' AS problem FROM documents WHERE NOT coalesce(lang IN ('en', 'de'), false) UNION ALL SELECT doc_id, 'text is long enough' FROM documents WHERE NOT coalesce(length(text) >= 200, false)
UNION ALL SELECT doc_id, 'length is right' FROM documents WHERE NOT coalesce(n_chars = length(text), false) UNION ALL SELECT doc_id, 'source is early' FROM documents WHERE NOT coalesce(TRY_CAST(substring(source, 4) AS INTEGER) < 15, false)"""),
    "split_order_check": (split_order_check, "SELECT part, o_orderkey, price, before FROM (SELECT o_orderpriority AS part, o_orderkey, round(o_totalprice, 2) AS price, lag(round(o_totalprice, 2)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS before FROM orders) WHERE before >= price"),
    "prompt_manifest_hash": (prompt_manifest_hash, "SELECT conv_id, sha256(string_agg(h, ',' ORDER BY turn, h)) AS sha256, sum(chars) AS chars FROM (SELECT conv_id, turn, sha256(concat_ws(chr(10), role, text)) AS h, length(text) AS chars FROM conversations) GROUP BY 1"),
    "manifest_full_diff": (manifest_full_diff, """SELECT k, change FROM (
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.v IS DISTINCT FROM b.v THEN 'different' END AS change
  FROM (SELECT c_custkey AS k, c_nationkey % 5 AS v FROM customer WHERE c_custkey % 7 <> 0) a FULL JOIN (SELECT o_custkey AS k, min(o_orderkey) % 5 AS v FROM orders GROUP BY 1) b ON a.k = b.k
) WHERE change IS NOT NULL"""),
    "paired_mode_pivot": (paired_mode_pivot, P.sql(P.RUNS, query="SELECT a.status AS raw, b.status AS diagnostic, count(*) AS n FROM runs a JOIN runs b ON a.case_id = b.case_id AND a.mode = 'raw' AND b.mode = 'diagnostic' GROUP BY 1, 2")),
    "failure_stage_case": (failure_stage_case, P.sql(P.RUNS, query="SELECT mode, coalesce(stage, 'none') AS stage, count(*) AS n, max(prompt_chars) AS longest_prompt, sum(attempt) AS attempts FROM runs GROUP BY 1, 2")),
    "pass_rates": (pass_rates, P.sql(P.RUNS, query="SELECT mode, attempt, count(*) AS n, count(*) FILTER (WHERE status = 'pass') AS passed, round(100 * count(*) FILTER (WHERE status = 'pass') / count(*), 4) AS percent FROM runs GROUP BY 1, 2")),
    "prompt_leak_scan": (prompt_leak_scan, "WITH " + _RUN_SQL.format("doc_id", "documents").replace("runs8", "d8") + ", " + _RUN_SQL.format("item_id", "benchmark").replace("runs8", "b8") + " SELECT d8.id AS doc_id, b8.id AS item_id, count(*) AS shared FROM d8 JOIN b8 ON d8.run = b8.run GROUP BY 1, 2"),
}
