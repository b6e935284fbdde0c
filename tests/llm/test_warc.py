import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from prefboard.llm import warc


def plainly(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r["html"] or "", []).append(r["page_id"])
    for r in rows:
        data = (r["html"] or "").encode()
        ids = [i for i in groups[r["html"] or ""] if i is not None]
        first = max(ids) if ids else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = first is not None and r["page_id"] != first
        out.append((r["page_id"], len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    trap = "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    rows = [
        (1, "http://a/", "", "x"),
        (2, None, None, "x"),
        (3, "http://b/\r\nWARC-Type: warcinfo", trap, "x"),
        (4, "http://c/", trap, "x"),
        (4, "http://c/", trap, "x"),
        (None, "http://d/", trap, "x"),
        (None, "http://d/", "alone", "x"),
        (5, "http://e/", "long " * 700_000, "x"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("compress", [False, True])
def test_round_trip(spark, pages, compress):
    path = warc.write_pages(pages, compress=compress)
    got = [tuple(r) for r in warc.archived_pages(spark, path).collect()]
    assert sorted(got, key=str) == plainly(pages.collect())
    texts = warc.read_warc(spark, path, ["record_type", "payload"]).where("record_type = 'response'").collect()
    assert sum(bytes(r["payload"]).startswith("<p>é".encode()) for r in texts) == 2


def test_least_bytes(spark, pages):
    path = warc.write_pages(pages, least_bytes=10)
    got = {r["page_id"]: r["record_type"] for r in warc.archived_pages(spark, path).collect()}
    assert got[1] == got[2] == "response" and got[3] == "revisit"


def test_no_pages(spark, pages):
    assert warc.archived_pages(spark, warc.write_pages(pages.limit(0))).count() == 0


def test_header_predicates_skip_records(spark, pages):
    path = warc.write_pages(pages)
    some = warc.read_warc(spark, path, ["record_type", "target_uri"], {"WARC-Type": ["revisit"]})
    assert {r["record_type"] for r in some.collect()} == {"revisit"}
    pushed = warc.read_warc(spark, path, ["record_type", "target_uri"], pushdown=True)
    pushed = pushed.where(F.col("record_type").isin("revisit", "none") & F.col("target_uri").startswith("http://b"))
    assert [r["record_type"] for r in pushed.collect()] == ["revisit"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_unwanted_payloads_are_not_read():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            Counting.taken += len(data)
            return data

    big = warc.record_bytes([("WARC-Type", "resource")], None, b"x" * 1_000_000)
    small = warc.record_bytes([("WARC-Type", "warcinfo")], None, b"y")
    stream = Counting(big + small)
    found = list(warc.read_records(stream, lambda h: h["warc-type"] == "warcinfo"))
    assert [f[3] for f in found] == [b"y"] and Counting.taken < 100
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(big[:-1000])))


def test_plans_partitions_of_even_bytes(tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.warc").write_bytes(warc.record_bytes([("WARC-Type", "resource")], None, b"x" * 1000))
    reader = warc.WarcReader(warc.RECORDS, {"path": str(tmp_path), "partitionbytes": "2200"})
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 1]
    (tmp_path / "_committed.json").write_text('[["3.warc", 1040]]')
    assert [len(p.paths) for p in reader.partitions()] == [1]


def test_every_append_to_a_folder_is_read(spark, pages, tmp_path):
    path = warc.write_pages(pages, path=f"file:{tmp_path}/pages")
    for times in (2, 3):
        warc.write_pages(pages, path=path)
        assert warc.read_warc(spark, path).count() == times * pages.count()
    warc.write_pages(pages.limit(0), path=path)
    assert warc.read_warc(spark, path).count() == 3 * pages.count()
    (tmp_path / "pages" / "part-lost.warc").write_bytes(b"half a rec")
    assert warc.read_warc(spark, path).count() == 3 * pages.count()
    warc.page_records(pages).write.format("warc").mode("overwrite").save(path)
    assert warc.read_warc(spark, path).count() == pages.count()
