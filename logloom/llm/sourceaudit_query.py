"""op13: how the sources of each language of `documents` differ in their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sourceaudit import audit


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=3, top=200)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS df FROM w GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(df) >= 3
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang
), m AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n
  FROM g LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (m.n + l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS q
  FROM m JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(coalesce((x.p - y.p) * (x.p - y.p) // y.p, 0)) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), s AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM s WHERE part = 'pair' OR rank <= 200
"""
