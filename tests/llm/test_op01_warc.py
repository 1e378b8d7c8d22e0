import gzip
import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import op01_warc as W


def record(body: bytes, kind="resource", extra="") -> bytes:
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def normalise(tmp_path, data: bytes):
    (tmp_path / "in.warc.gz").write_bytes(data)
    rows = W.normalise_file(f"file://{tmp_path}/in.warc.gz", f"file://{tmp_path}/out.warc.gz")
    return rows, (tmp_path / "out.warc.gz").read_bytes()


def test_every_record_is_a_member(tmp_path):
    bodies = [b"", b"a" * 3_000_000, b"\r\n\r\nWARC/1.0\r\n", "é".encode(), b"a"]
    whole = b"".join(record(b, extra="WARC-Record-ID: <x>\r\nwarc-record-id: <y>\r\n") for b in bodies)
    rows, out = normalise(tmp_path, gzip.compress(whole))
    assert gzip.decompress(out) == whole
    assert [r[1] for r in rows] == list(range(5)) and {r[7] for r in rows} == {"<x>"} and {r[8] for r in rows} == {None}
    for r, b in zip(rows, bodies):
        member = zlib.decompress(out[r[2] : r[2] + r[3]], 31)
        assert member == whole[r[4] : r[4] + len(member)]
        assert (r[5], r[9]) == (len(b), hashlib.sha256(b).hexdigest())
    assert rows[-1][2] + rows[-1][3] == len(out)


def test_many_members_are_read_through(tmp_path):
    data = b"".join(gzip.compress(record(bytes([65 + i]) * 10)) for i in range(4))
    rows, out = normalise(tmp_path, data)
    assert len(rows) == 4 and gzip.decompress(out) == gzip.decompress(data)


def test_empty_file(tmp_path):
    assert normalise(tmp_path, b"") == ([], b"")
    assert normalise(tmp_path, gzip.compress(b"")) == ([], b"")


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress(record(b"a") + record(b"b" * 1000))[:-20],
        gzip.compress(record(b"a")) + b"no gzip at all",
        gzip.compress(record(b"a") + b"no header\r\n\r\n"),
        gzip.compress(record(b"a") + b"WARC/1.0\r\nContent-Length: x\r\n\r\n"),
        gzip.compress(record(b"a") + b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"),
        gzip.compress(record(b"a") + b"WARC/1.0\r\nContent"),
    ],
)
def test_whole_records_before_a_fault_are_kept(tmp_path, data):
    rows, out = normalise(tmp_path, data)
    assert [r[1] for r in rows][-1] == -1 and rows[-1][10]
    assert gzip.decompress(out).startswith(record(b"a"))


@settings(max_examples=30, deadline=None)
@given(bodies=st.lists(st.binary(max_size=200), max_size=8))
def test_round_trip(tmp_path_factory, bodies):
    whole = b"".join(map(record, bodies))
    rows, out = normalise(tmp_path_factory.mktemp("w"), gzip.compress(whole))
    assert (gzip.decompress(out) if out else b"") == whole and len(rows) == len(bodies)


def test_pages(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", 5), (None, None, None, 6), (1, "http://a/\r\nX: y", "<p>é</p>", 5), (2, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset long")
    files = W.pages_to_monolithic(pages, f"file://{tmp_path}/whole")
    index = W.write_index(W.normalise(spark, files, f"file://{tmp_path}/members"), f"file://{tmp_path}/index")
    got = sorted((r.record_id or "", r.target_uri or "", r.body.decode()) for r in W.read_records(index).collect())
    one = ("<urn:page:1>", "http://a/%0D%0AX: y", "<p>é</p>")
    assert got == [("", "", ""), one, one, ("<urn:page:2>", "u", "")]
    assert W.pages_to_monolithic(pages.limit(0), f"file://{tmp_path}/none") == []
    assert W.normalise(spark, [], f"file://{tmp_path}/none2").count() == 0
