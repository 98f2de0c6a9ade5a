import gzip
import hashlib

import pytest

from logloom.llm import warc as W
from logloom.llm import warc_query as Q

from .oracle import rows_of_frame, rows_of_sql

LONG = "<p>é WARC/1.1\r\n\r\n</p>\n" * 30


def pages():
    return [(1, "http://a b/\n", LONG), (2, None, LONG), (5, "http://x/", None), (6, "http://x/", ""), (7, "u", "short"), (8, "u", "short"), (0, "http://z/", LONG + "x"), (3, "http://z/", LONG + "x"), (3, "http://z/", LONG + "x"), (0, "http://z/", LONG + "x"), (None, None, LONG), (10, "http://y/", "\n\nfiledesc://x 1 2 3 4\n" * 9000)]


def expected(rows):
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and key is not None and key > first[html or ""]
        out.append((str(key), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, parts):
    df = spark.createDataFrame([(*p, "x") for p in pages()], "page_id long, url string, html string, content string").repartition(parts)
    got = W.archived(df).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(pages())
    ids = {r.page_id: r.record_id for r in got}
    assert len(set(ids.values())) == len(ids)
    assert len({r.record_id for r in got}) == len(pages())
    assert {r.target_uri for r in got if r.page_id in (1, 2)} == {"http://a%20b/%0A", "unknown:2"}


def test_files_have_a_bound(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    W.write_arc(df, f"{tmp_path}/arc", 3000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in tmp_path.glob("arc/*.gz")]
    assert len(sizes) > 3 and sorted(sizes)[-2] < 5000  # the longest page is a file by itself
    W.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", file_bytes=3000)
    got = W.read_warc(spark, f"{tmp_path}/warc").collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(pages())
    assert len({r.record_id for r in got}) == len(pages())


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_arc_by_length(version, step, monkeypatch):
    records = [W.arc_record(version, f"http://x/{i}", i, b"\n\n" * i + b"filedesc://x 1 2 3 9\n" * (i % 3)) for i in range(20)]
    data = b"\n".join([W.arc_version_block(version, "a.arc"), *records, b""])
    packed = gzip.compress(data[:700]) + gzip.compress(data[700:])
    monkeypatch.setattr(W.Stream.__init__, "__defaults__", (step,))
    for file in (data, packed):
        got = list(W.arc_records(file))
        assert [h["URL"] for h, _ in got] == [f"http://x/{i}" for i in range(20)]
        assert [len(h) for h, _ in got] == [len(W.ARC_FIELDS[version])] * 20
        assert [W.http_parts(c)[1] for _, c in got] == [b"\n\n" * i + b"filedesc://x 1 2 3 9\n" * (i % 3) for i in range(20)]


def test_broken_archives():
    good = W.arc_version_block(1, "a") + b"\n" + W.arc_record(1, "u", 1, b"abc")
    for bad in (good[:-1], good.replace(b"u 192", b"u v 192"), W.arc_record(1, "u", 1, b"abc"), b"junk\n"):
        with pytest.raises(ValueError):
            list(W.arc_records(bad))
    with pytest.raises(ValueError):
        list(W.warc_records(b"junk\r\n"))


def test_times():
    assert W.iso_time("19960923142103") == "1996-09-23T14:21:03Z" and W.iso_time("1996") == "1996-01-01T00:00:00Z"


def test_empty_table(spark):
    assert W.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert rows_of_frame(Q.query(spark, sf)) == rows_of_sql(Q.ORACLE_SQL, sf)
