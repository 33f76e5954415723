"""WARC round trip: every payload, digest and revisit comes back, member by member."""

import gzip
import hashlib

import pyarrow.fs
import pytest

from evalspark.llm import warc
from evalspark.llm.files import open_fs
from evalspark.session import scratch_path


def pages(spark):
    long, other = "<p>é line\r\n\r\nend" * 100, "x" * 999
    rows = [(1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (3, None, other), (4, "u", other), (5, "u", None), (6, "u", ""), (None, "u", long), (2, "again", long), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    long = rows[0][2]
    for page_id, url, html in rows:
        data = (html or "").encode()
        own = [r for r in got if r.page_id == page_id and r.payload_digest == hashlib.sha1(data).hexdigest()]
        assert own and {r.payload_bytes for r in own} == {len(data)}
        for r in own:
            assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or r.payload == (html or ""))
    copies = [r for r in got if r.payload_digest == hashlib.sha1(long.encode()).hexdigest()]
    assert sorted(r.record_type for r in copies) == ["response", "revisit", "revisit", "revisit"]
    assert {r.refers_to for r in copies if r.record_type == "revisit"} == {2}
    assert [r.page_id for r in copies if r.record_type == "response"] == [2]
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 1000)


def test_members_and_index(spark):
    df, rows = pages(spark)
    base = scratch_path(spark, "warc-test")
    warc.write_archives(warc.with_record_types(df), f"{base}/plain", records_per_file=4)
    index = warc.normalise(spark, f"{base}/plain", warc.local_uri(f"{base}/members"))
    entries = index.collect()
    assert len(entries) == len(rows)
    fs, root = open_fs(f"{base}/plain")
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if info.path.endswith(".gz"):
            with fs.open_input_file(info.path) as f:
                data = f.read()
            assert data.count(b"\x1f\x8b\x08") >= 1 and gzip.decompress(data).startswith(b"WARC/1.1")
    for e in entries:
        fs, path = open_fs(e.archive)
        with fs.open_input_file(path) as f:
            f.seek(e.offset)
            assert gzip.decompress(f.read(e.length)).startswith(b"WARC/1.1\r\nWARC-Type: " + e.record_type.encode())


def test_broken_streams():
    head = b"WARC/1.1\r\nContent-Length: 5\r\n\r\n"
    assert len(list(warc.split_records(iter([head[:9], head[9:] + b"ab", b"cde\r\n\r\n" + head + b"abcde\r\n\r\n"])))) == 2
    for bad in ([head + b"abc"], [head + b"abcdefghi"], [b"WARC/1.1\r\nContent"], [b"HTTP/1.1\r\n\r\n"]):
        with pytest.raises(ValueError):
            list(warc.split_records(iter(bad)))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string, extra int")).count() == 0
