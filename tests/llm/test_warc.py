import gzip
import hashlib

from tastemill.llm import warc
from tastemill.llm.common import open_store
from tastemill.session import scratch_folder

ROWS = [
    (1, "http://a/x y", "x" * 2000), (5, "http://a/2", "x" * 2000), (3, None, "x" * 2000), (2, "http://b", "short"),
    (4, "http://b", "short"), (6, "http://c", None), (7, "http://c", ""), (8, "http://d", "é" * 600),
    (9, "http://d", "é" * 600), (10, "http://e", "HTTP/1.1\r\n\r\nWARC/1.0 \x00 " + "z" * 1000),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    got = {r["page_id"]: r for r in warc.round_trip(pages(spark, ROWS).repartition(4)).collect()}
    refers = {1: 5, 3: 5, 8: 9}
    assert len(got) == len(ROWS)
    for i, _, html in ROWS:
        payload = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", refers[i]) if i in refers else ("response", None))


def test_repeats_missing_ids_and_empty_tables(spark):
    rows = [(1, "u", "q" * 1500), (1, "u", "q" * 1500), (None, "u", "q" * 1500), (None, None, None)]
    got = warc.round_trip(pages(spark, rows).selectExpr("*", "1 AS file", "2 AS size")).collect()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [("1", "response", None), ("1", "revisit", 1), ("None", "response", None), ("None", "revisit", 1)]
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def arc(version, *records, blank=b"\n"):
    block = f"{version} 0 org\n{warc.FIELDS[version]}\n\n".encode()
    out = f"filedesc://f 0.0.0.0 20010203040506 text/plain {len(block)}\n".encode() + block + blank
    for url, content in records:
        out += warc.arc_header(version, url, "text/html", len(content), "f", 9) + content + blank
    return out


def test_both_versions_plain_and_packed():
    content = b"HTTP/1.0 200 OK\nX-Page-Id: 12\n\nbody\nhttp://x 1 2 3 4\n"
    for version in (1, 2):
        data = arc(version, ("http://x/a b", content), ("dns:x", b"20010101 1.2.3.4\n"), ("ftp://y", b""))
        for form in (data, gzip.compress(data)):
            a, b, c = warc.read_arc(form)
            assert (a.url, a.mime, a.key, a.payload) == ("http://x/a b", "text/html", 12, b"body\nhttp://x 1 2 3 4\n")
            assert (b.http, b.payload, c.payload, c.truncated) == (b"", b"20010101 1.2.3.4\n", b"", False)
    cut = arc(1, ("http://x", content))[:-10]
    assert next(warc.read_arc(cut)).truncated


def test_warc_headers():
    record = warc.Record("http://x", "1.2.3.4", "2001", "text/html", b"HTTP/1.1 200 OK\r\n\r\n", b"body", True)
    digest = hashlib.sha1(b"body").hexdigest()
    headers, block = next(warc.read_warc(warc.converted(record, digest, None)))
    assert headers["WARC-Type"] == "response" and block.endswith(b"body") and headers["WARC-Truncated"] == "length"
    assert headers["WARC-Date"] == "2001-01-01T00:00:00Z"
    assert headers["WARC-Payload-Digest"].startswith("sha1:") and headers["WARC-Record-ID"].startswith("<urn:uuid:")
    again, block = next(warc.read_warc(warc.converted(record, digest, (7, "http://y", "20020304"))))
    assert again["WARC-Type"] == "revisit" and block == record.http and again["WARC-Profile"] == warc.PROFILE
    assert again["WARC-Refers-To"] == warc.record_id("http://y", "20020304", 7, digest)


def test_files_are_closed_by_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    folder = scratch_folder(spark, "arc")
    manifest = warc.write_arc(pages(spark, ROWS).coalesce(1), folder).collect()
    assert len(manifest) > 2 and sum(r["records"] for r in manifest) == len(ROWS)
    store, root = open_store(folder)
    versions = set()
    for r in manifest:
        with store.open_input_stream(f"{root}/{r['file']}", compression=None) as f:
            versions.add(gzip.decompress(f.read()).split(b"\n")[1][:1])
    assert versions == {b"1", b"2"}
