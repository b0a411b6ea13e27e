import gzip
import hashlib
import io

import pytest

from tests.llm.conftest import rows_of
from tillrec.llm import common, warc

BIG = "<html>" + "é" * 80 + "</html>"
SCHEMA = "page_id long, url string, html string, digest string, bytes int"


@pytest.fixture
def archive(spark):
    def write(rows):
        path = common.shared_path(spark, "warc-test")
        warc.write_archives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), path)
        return path
    return write


def test_round_trip_revisits_and_edges(spark, archive):
    pages = [(3, "http://a/\r\nEvil: 1", BIG), (1, None, BIG), (2, "http://b/", None), (4, "http://c/", ""),
             (5, "u", "WARC/1.1\r\n\r\n\r\n"), (6, "u", "tiny"), (7, "u", "tiny"), (None, "u", BIG), (1, "again", BIG),
             (8, "u", "x" * 300_000)]
    path = archive(pages)
    got = sorted(rows_of(warc.digests(warc.read_archives(spark, path, "digest")),
                         "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [(i, size(h), sha(h), "revisit" if h == BIG and i != 1 else "response", 1 if h == BIG and i != 1 else None)
            for i, _, h in pages]
    assert got == sorted(want, key=str)
    back = {r["record_id"]: r for r in warc.read_archives(spark, path).filter("warc_type = 'response'").collect()}
    assert bytes(back["<urn:tillrec:page:5>"]["payload"]) == b"WARC/1.1\r\n\r\n\r\n"
    assert bytes(back["<urn:tillrec:page:1>"]["payload"]).decode() == BIG


def test_empty_table(spark, archive):
    assert warc.digests(warc.read_archives(spark, archive([]), "digest")).collect() == []


def test_filters_reach_the_reader(spark, archive):
    path = archive([(1, "http://a/1", BIG), (2, "http://b/2", BIG)])
    found = warc.read_archives(spark, path).filter("warc_type = 'revisit' AND target_uri LIKE 'http://b/%'")
    assert rows_of(found, "record_id", "payload") == [("<urn:tillrec:page:2>", None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "") or "warc_type" not in plan.split("BatchScan")[0]


def test_unwanted_blocks_are_skipped_not_read():
    class Counting(io.BytesIO):
        biggest = 0

        def read(self, n=-1):
            self.biggest = max(self.biggest, n)
            return super().read(n)

    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 5000
    record = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" + block + b"\r\n\r\n"
    stream = Counting(record % (b"request", len(block)) + record % (b"response", len(block)))
    wanted = [("in", "warc-type", ("response",))]
    assert [r[1] for r in warc.records(stream, "f", wanted, "none")] == ["response"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(record[:200] % (b"response", len(block))), "f", [], "bytes"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"junk\r\n"), "f", [], "bytes"))


def test_gzip_members_per_record(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    (tmp_path / "b.warc").write_bytes(one)
    got = warc.read_archives(spark, str(tmp_path))
    assert [bytes(p) for (p,) in rows_of(got, "payload")] == [b"abc"] * 3


def test_files_are_packed_into_partitions(tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.warc").write_bytes(b"x" * 100)
    parts = warc.WarcReader({"path": str(tmp_path), "partitionBytes": "250"}).partitions()
    assert len(parts) == 4 and sorted(f for p in parts for f in p.files) == sorted(str(p) for p in tmp_path.iterdir())
