"""op12: how five filters of `documents` interact, over all their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .filteraudit import interactions


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Applies the filters one after the other, order by order, to the documents themselves.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), f AS (
  SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > least, false) AS e
  FROM w
), l AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS bad FROM labels GROUP BY doc_id
), g AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS before FROM o, generate_series(1, 5) AS k(step) WHERE length(filter_order) = 5
), x AS (
  SELECT s.*, g.*, translate(before, fails, '') = before AS reached, contains(fails, filter) AS failed FROM s, g
), r AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN reached AND NOT failed THEN n ELSE 0 END) AS kept, sum(CASE WHEN reached AND failed THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN NOT reached AND failed THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN reached AND failed THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN reached AND failed THEN bad ELSE 0 END) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r
"""
