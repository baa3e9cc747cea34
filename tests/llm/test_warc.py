import gzip
import io
import random

import pytest

from tests.llm.helpers import clashing
from tidewake.llm import warc
from tidewake.llm.queries import QUERIES, SQL
from tests.oracle import compare, connection

PAGES = "page_id long, url string, html string"
SF = "/root/testdata/sf0.001"


def read(data):
    return list(warc.Reader(io.BytesIO(data)))


def want(rows):
    """Brute force: (page_id, bytes, digest, kind, refers_to) of each row, sorted."""
    latest = {}
    for i, _, html in rows:
        x = (html or "").encode()
        latest[x] = max((k for k in (i, latest.get(x)) if k is not None), default=None)
    out = []
    for i, _, html in rows:
        x = (html or "").encode()
        revisit = i != latest[x]
        out.append((i, len(x), warc.digest(x), "revisit" if revisit else "response", latest[x] if revisit else None))
    return sorted(out, key=str)


def test_query_equals_its_sql(spark):
    assert compare(spark, connection(SF), QUERIES["op11_warc"], SQL["op11_warc"], SF) is None


def test_odd_rows_give_their_records(spark):
    rows = [
        (1, "http://a/ü \r\nx", None), (2, None, ""), (3, "http://b", "é" * 200_000), (3, "http://b", "é" * 200_000), (5, "u", "\r\n\r\nWARC/1.1\r\n\0"),
        (None, "n", "same"), (7, "m", "same"), (None, None, "alone"), (8, "z", "\0"), (9, "z", "\0"),
    ]
    path = warc.archived(clashing(spark.createDataFrame(rows, PAGES)), most=4096)
    found = warc.records(spark, path)
    assert sorted(map(tuple, warc.page_rows(found).collect()), key=str) == want(rows)
    payloads = {r.record_id: bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()}
    assert payloads == {f"urn:page:{'null' if i is None else i}": h or "" for i, _, h in rows if (i, h) not in ((1, None), (None, "same"), (8, "\0"))}
    assert found.where("record_type = 'revisit' AND octet_length(payload) > 0").isEmpty()
    assert {r.target_uri for r in found.where("record_id = 'urn:page:1'").collect()} == {"http://a/%C3%BC%20%0D%0Ax"}
    assert warc.unresolved(found).isEmpty()
    assert warc.unresolved(found.where("record_id <> 'urn:page:7'")).count() == 1


def test_an_empty_table_gives_no_records(spark):
    assert warc.records(spark, warc.archived(spark.createDataFrame([], PAGES))).count() == 0


def test_short_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    found = warc.page_rows(warc.records(spark, warc.archived(spark.createDataFrame(rows, PAGES), least=3)))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found.collect()) == [
        (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None),
    ]


def test_archives_are_gzip_files_of_bounded_size(spark):
    rng = random.Random(3)
    rows = [(i, "u", "".join(rng.choices("abcdefgh", k=900))) for i in range(200)]
    path = warc.archived(spark.createDataFrame(rows, PAGES).coalesce(1), most=20_000)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    assert len(files) > 3 and all(len(x) < 20_400 for x in files)
    for x in files:  # a plain gzip reader takes them too, and finds the closing record at the end
        whole = gzip.decompress(x)
        n = whole.count(b"WARC/1.1\r\n") - 1
        assert whole.endswith(b"record-count: %d\r\n\r\n\r\n" % n)


def sample(n=3):
    pages = [warc.page_record(i, f"http://x/{i}", b"<p>%d</p>" % i * 50, None, False) for i in range(n)]
    return pages, warc.member("metadata", "urn:uuid:1", "application/warc-fields", b"record-count: %d\r\n" % n)


def test_records_have_places_in_the_stream():
    pages, close = sample()
    found = read(b"".join([*pages, close]))
    assert [r.position for r in found] == [0, len(pages[0]), len(pages[0] + pages[1]), sum(map(len, pages))]
    assert [r.payload_bytes for r in found[:3]] == [400] * 3 and all(r.fault is None for r in found)


def test_parts_are_inflated_as_needed():
    big = bytes(5 << 20)
    one = warc.page_record(1, None, big, None, False)
    assert len(one) < 10_000  # far more comes out than goes in, in parts
    (r,) = read(one)
    assert r.payload == big and r.fault is None


def test_faults_are_found():
    pages, close = sample()
    assert read(b"".join([*pages[:2], close]))[-1].fault == "2 records where 3 were written"
    plain = gzip.decompress(pages[1])
    wrong = plain.replace(b"<p>1</p>", b"<p>2</p>", 1)
    found = read(pages[0] + gzip.compress(wrong) + pages[2])
    assert [bool(r.fault) for r in found] == [False, True, False] and "block digest" in found[1].fault
    no_block = b"\r\n".join(x for x in wrong.split(b"\r\n") if not x.startswith(b"WARC-Block"))
    assert "payload digest" in read(gzip.compress(no_block))[0].fault


@pytest.mark.parametrize(
    "bad",
    [
        b"plain", sample()[0][0][:-9], gzip.compress(b"HTTP/1.1 200\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n"),
        gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"),
        gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n"), sample()[0][0] + b"\0\0",
    ],
)
def test_what_is_no_record_is_refused(bad):
    with pytest.raises(warc.Broken):
        read(bad)


def test_other_writers_records_are_read():
    sha1 = "sha1:" + __import__("hashlib").sha1(b"body").hexdigest()
    head = f"WARC/1.0\r\nwarc-type:response\r\nWARC-Target-URI: <http://x>\r\nX-Long: a\r\n b\r\nWARC-Payload-Digest: {sha1}\r\nContent-Type: application/http; msgtype=response\r\n"
    (r,) = read(gzip.compress(f"{head}Content-Length: 23\r\n\r\nHTTP/1.0 200 OK\r\n\r\nbody\r\n\r\n".encode()))
    assert (r.payload, r.fault, r.link("warc-target-uri"), r.fields["x-long"]) == (b"body", None, "http://x", "a b")


def test_a_broken_archive_is_a_row_where_it_may_be(spark, tmp_path):
    pages, close = sample()
    (tmp_path / "good").write_bytes(b"".join([*pages, close]))
    (tmp_path / "bad").write_bytes(pages[0] + b"junk" + pages[1])
    found = warc.records(spark, f"file://{tmp_path}", strict=False)
    assert found.where("fault IS NULL").count() == 5 and found.where("fault IS NOT NULL AND record_type IS NULL").count() == 1
    with pytest.raises(Exception, match="junk|gzip"):
        warc.records(spark, f"file://{tmp_path}").count()
