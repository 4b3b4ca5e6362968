import base64
import gzip
import hashlib
import zlib

import pytest
from quillon.llm.warc import http_parts, read_arc, read_files, read_warc, warc_round_trip


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), i)
    return sorted(((i, len((h or "").encode()), digest((h or "").encode()), *(("response", None) if i == top[h or ""] else ("revisit", top[h or ""]))) for i, _, h in rows), key=str)


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/b c", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://ü.de/?q=1", None), (4, "u", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
            (6, "u", "\n\n1 2 3\n" * 5), (7, "u", "ü" * 700_000), (8, "u", "same"), (8, "u", "same"), (9, "u", "ü" * 700_000)]
    rows += [(100 + k, "http://hot/", "hot page") for k in range(300)]
    df = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, uri string").repartition(4)
    assert sorted(map(tuple, warc_round_trip(df).collect()), key=str) == brute(rows)


def test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc_round_trip(df).collect()), key=str) == brute(rows)


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "u", "x"), (1, "u", "x"), (None, "u", "y")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()), key=str)
    assert got == [(1, "response", None), (None, "response", None), (None, "revisit", 1)]
    assert warc_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("version, line", [(1, "http://a/ 1.2.3.4 19970102030405 text/html {n}"), (2, "http://a/ 1.2.3.4 19970102030405 text/html 200 - - 0 f.arc {n}")])
def test_arc_versions(version, line):
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    block = f"{version} 0 X\n{names}\n".encode()
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\none\ntwo\n"
    content = f"filedesc://f 0.0.0.0 19970101000000 text/plain {len(block)}\n".encode() + block + b"\n" + line.format(n=len(body)).encode() + b"\n" + body + b"\n"
    for c in (content, gzip.compress(content[:50]) + gzip.compress(content[50:])):
        [(head, got)] = list(read_arc(c))
        assert got == body and head["Archive-date"] == "19970102030405"
    assert http_parts(body)[0] == {"A": "b"} and http_parts(body)[2] == b"one\ntwo\n"
    with pytest.raises(ValueError):
        list(read_arc(content[:-10]))


def test_files_are_plain_warc(spark, tmp_path):
    from quillon.llm.warc import convert_arc, write_arc

    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string").coalesce(1)
    write_arc(df, f"file://{tmp_path}/arc")
    convert_arc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    for r in read_files(spark, f"file://{tmp_path}/warc").collect():
        # one gzip member for each record, each readable on its own by any gzip reader
        members, rest = [], bytes(r.content)
        assert gzip.decompress(rest)
        while rest:
            z = zlib.decompressobj(31)
            members.append(z.decompress(rest))
            assert z.eof
            rest = z.unused_data
        assert [m[:8] for m in members] == [b"WARC/1.1"] * 3 and all(m.endswith(b"\r\n\r\n") for m in members)
    heads = [h for r in read_files(spark, f"file://{tmp_path}/warc").collect() for h, _ in read_warc(bytes(r.content))]
    assert {h["WARC-Type"] for h in heads} == {"warcinfo", "response", "revisit"}


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b/ü 1", "u", "x"), ("a", "u", "x"), ("10", "u", "y"), ("9", "u", "y")], "page_id string, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc_round_trip(df).collect())
    assert got == [("10", "revisit", "9"), ("9", "response", None), ("a", "revisit", "b/ü 1"), ("b/ü 1", "response", None)]


def test_members_of_large_records():
    from quillon.llm.warc import Inflated, member

    for size in (0, 1, (1 << 24) - 1, 1 << 24, (1 << 24) + 5):
        source = Inflated((member(b"x" * size) + b"\0") * 2 + member(b"end\n") + b"\0")
        assert source.take(2 * size) == b"x" * (2 * size) and source.until(b"\n") == b"end"
