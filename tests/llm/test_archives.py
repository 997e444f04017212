"""Archives of others: revisits by the standard fields alone, records in pieces of any size."""

import gzip

import pytest

from tidewell.llm import warc


def record(kind, rid, body=b"", **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "Content-Length": len(body), **{k.replace("_", "-"): v for k, v in fields.items()}}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def test_revisits_of_foreign_archives(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"
    a = [record("warcinfo", "<i>", b"x"), record("response", "<a>", page, WARC_Payload_Digest="sha1:AAA", WARC_Target_URI="http://x/"), record("response", "<b>", page, WARC_Payload_Digest="sha1:BBB")]
    b = [record("revisit", "<r1>", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<a>", WARC_Payload_Digest="sha1:BBB"), record("revisit", "<r2>", WARC_Payload_Digest="sha1:BBB"), record("revisit", "<r3>", WARC_Refers_To="<gone>", WARC_Payload_Digest="sha1:AAA"), record("revisit", "<r4>", WARC_Refers_To="<gone>"), record("revisit", "<r5>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, a)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(b)))
    read = warc.read_warc(spark, f"file://{tmp_path}")
    rows = {r.record_id: r for r in read.collect()}
    assert set(rows) == {"<a>", "<b>", "<r1>", "<r2>", "<r3>", "<r4>", "<r5>"} and bytes(rows["<a>"].payload) == b"<p>hello</p>" and rows["<r1>"].refers_to_id == "<a>"
    got = {r.record_id: r.response_id for r in warc.responses_of(read).collect()}
    assert got == {"<r1>": "<a>", "<r2>": "<b>", "<r3>": "<a>", "<r4>": None, "<r5>": None}
    assert warc.responses_of(read.limit(0)).count() == 0


def test_segments_keep_the_origins_identifier(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "http://x/", "word " * 30000), (2, "http://y/", "word " * 30000)], "page_id long, url string, html string"), f"file://{tmp_path}/w", segment=4096)
    read = warc.read_warc(spark, f"file://{tmp_path}/w")
    rows = {r.page_id: r for r in read.collect()}
    assert rows[2].record_type == "revisit" and rows[2].refers_to_id == rows[1].record_id and len(rows[1].payload) == 150000
    assert [tuple(r) for r in warc.responses_of(read).collect()] == [(rows[2].record_id, rows[1].record_id)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10**6])
def test_records_in_pieces(size):
    data = b"".join(record("resource", f"<{k}>", b"\r\n\r\n" * k + b"WARC/1.0\r\n") for k in range(9))
    pieces = [data[a : a + size] for a in range(0, len(data), size)]
    assert [(f["warc-record-id"], b) for f, b in warc.records(pieces)] == [(f["warc-record-id"], b) for f, b in warc.parse_records(data)] and len(list(warc.records(pieces))) == 9
    for bad in (data[:-3], data + b"x", b"WARC/1.0\r\nContent-Length: 3\r\n", b"WARCX" + data[5:]):
        with pytest.raises(ValueError):
            list(warc.records([bad[a : a + size] for a in range(0, len(bad), size)]))
    assert list(warc.records([])) == []
