import numpy as np

from logloom.llm import urlfilter as U
from logloom.llm import urlfilter_query as Q


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host.encode().lower().decode(), tail[:end]


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x#y", "http://a.example.net/de/", "http://example.net", "ftp://x://y/z", "http://example.com/de/1", "http://badexample.com/de/", "http://ORG/fr/", "http://a.org/fr", "http://a.org/fr/?q=/", "http://ÄB.org/fr/x\ny", "http://h?://p/", "http://spam.test/a/", "https://www.spam.test:443/a#b", "http://u@m.spam.test/a/?q", "http://spam.test/b", "net://net/", "http://.net/x"]


def test_hosts_paths_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], None), (4, URLS[4], "x")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("HTTP://spam.test/a",), (None,), ("nothing",), ("http://www.spam.test/a/",)], "url string")
    got = U.judged(pages, listed, Q.RULES).collect()
    assert len(got) == len(URLS) + 2
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    for i, u in enumerate(URLS):
        host, path = plain(u)
        fits = [r for r in Q.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)
        assert (by_id[i].host, by_id[i].path) == (host, path), u
        assert by_id[i].rule == (rule.host + rule.path if rule else None), u
        on_list = u is not None and "spam.test" in u and path.rstrip("/") == "/a"
        assert by_id[i].listed == on_list and by_id[i].verdict == (rule.verdict if rule else "block" if on_list else "allow"), u


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(20_000).selectExpr("concat('x', id) AS canonical")
    found = U.build(listed)
    assert found.blocks.shape == (625, U.WORDS)
    other = spark.range(20_000).selectExpr("concat('y', id) AS canonical")
    assert U.passing(listed, found).where("maybe").count() == 20_000
    assert U.passing(other, found).where("maybe").count() < 200
    small = U.build(listed, most_blocks=4)
    assert len(small.blocks) == 4 and U.passing(listed, small).where("maybe").count() == 20_000


def test_every_bit_of_a_block_can_be_set():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 200_000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    block, bits = U.Filter.places(hashes, 3)
    assert set(block.tolist()) == {0, 1, 2} and (np.bitwise_or.reduce(bits, axis=0) == np.uint64((1 << 64) - 1)).all()


def test_empty_tables(spark):
    pages, listed = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string")
    assert U.judged(pages, listed, Q.RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r.verdict for r in U.judged(one, listed, Q.RULES).collect()] == ["allow"]
    assert [r.verdict for r in U.judged(one, one.select("url"), []).collect()] == ["block"]


def test_list(spark):
    urls = {r.url for r in Q.listed_urls(spark).collect()}
    assert len(urls) == 2 * 6 * 3 * 4 * 2 * 1000 and "http://blog.cheap-pills.example.net/de/612.html" in urls and "http://ads-track.example.com/en/0" in urls


def test_query_against_sql(spark):
    from .oracle import rows_of_frame, rows_of_sql

    sf = "/root/testdata/sf0.01"
    assert rows_of_frame(Q.query(spark, sf)) == rows_of_sql(Q.ORACLE_SQL, sf)
