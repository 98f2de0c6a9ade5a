"""op10: judges every `pages` url by four rules and a list of spam sites' pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .urlfilter import Rule, judged

# Fixed values of the rules.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]

#: The list is made by a rule: pages 0 to 999 in each language, as bare paths and as .html, of these sites and their blogs.
SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS, LANGS, PAGES, FORMS, BLOGS = ("com", "net", "org"), ("de", "en", "es", "fr"), 1000, ("", ".html"), ("", "blog.")


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list, column url."""
    parts, n, rest = [], F.col("id"), 1
    for values in (BLOGS, SITES, DOMAINS, LANGS, FORMS):
        parts.append(F.element_at(F.array(*map(F.lit, values)), (F.floor(n / rest) % len(values) + 1).cast("int")))
        rest *= len(values)
    blog, site, domain, lang, form = parts
    page = F.floor(n / rest).cast("string")
    return spark.range(rest * PAGES).select(F.concat(F.lit("http://"), blog, site, F.lit(".example."), domain, F.lit("/"), lang, F.lit("/"), page, form).alias("url"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed_urls(spark), RULES)


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), tested AS (
  SELECT *,
         coalesce(regexp_matches(
           regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '^(www|m)\.', '') || regexp_replace(path, '/+$', ''),
           '^(blog\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)/(de|en|es|fr)/(0|[1-9][0-9]{0,2})(\.html)?$'), false) AS listed,
         CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM tested
"""
