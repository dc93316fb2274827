"""Legacy ARC archives, and their conversion to WARC.

An ARC file starts with a version block, which says how many fields the header
line of each record has. A record is that line, the declared number of bytes, and
a line end. The converter reads files of either version and synthesises what
WARC asks for and ARC lacks: record identifiers, ISO timestamps, record types,
payload and block digests. Of records with equal payloads one stays a response;
the others become revisits of it and carry only their HTTP header.

Payloads are never shuffled: a first pass over the ARC files reports a line per
record, the verdicts are found by an aggregation and a join by digest, and a
second pass, file by file, writes the WARC records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import open_store, stored
from tastemill.session import scratch_folder

# Fixed by the formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename"
    " Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# Payloads under this size are always stored.
MIN_REVISIT = 1000
# A task closes a file once it holds so many bytes before compression.
FILE_BYTES = 32_000_000
FETCHED = "20240101000000"
LEVEL = 2
KEY_HEADER = "X-Page-Id"
NAMESPACE = uuid.UUID("6f0f2c62-5c1c-4d0a-9a57-3f6b8a4d2c11")


@dataclass(frozen=True)
class Record:
    """A record of an ARC file; ``http`` is the header block, with its blank line."""

    url: str
    ip: str
    date: str
    mime: str
    http: bytes
    payload: bytes
    truncated: bool

    @property
    def key(self) -> int | None:
        found = re.search(rb"(?im)^%s: (-?[0-9]+)\r?$" % KEY_HEADER.encode(), self.http)
        return int(found[1]) if found else None


def _opened(data: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(data)
    return gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header block and payload; content of other protocols is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, blank, body = content.partition(b"\r\n\r\n")
    if not blank:
        head, blank, body = content.partition(b"\n\n")
    return head + blank, body


def read_arc(data: bytes) -> Iterator[Record]:
    """Records of an ARC file, plain or of gzip members, version 1 or 2.

    The fields are split from the right, as old URLs may hold blanks. A record
    with fewer bytes than declared is the last and is marked as truncated.
    """
    source = _opened(data)
    version = None
    while line := source.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if version is None:
            parts = text.split(" ")
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with a version block")
            block = source.read(int(parts[-1]))
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        parts = text.rsplit(" ", len(FIELDS[version].split()) - 1)
        length = int(parts[-1])
        content = source.read(length)
        http, payload = split_http(content)
        yield Record(*parts[:4], http, payload, len(content) < length)


def arc_header(version: int, url: str, mime: str, length: int, name: str, offset: int) -> bytes:
    first = f"{url} 127.0.0.1 {FETCHED} {mime}"
    if version == 2:
        first += f" 200 - - {offset} {name}"
    return f"{first} {length}\n".encode()


def safe_url(url: str | None) -> str:
    """A URL without blanks and control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def http_block(key: int | None, length: int) -> bytes:
    named = "" if key is None else f"{KEY_HEADER}: {key}\r\n"
    return (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"{named}Content-Length: {length}\r\n\r\n"
    ).encode()


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Pages (page_id, url, html) as ARC files; returns ``(file, records)``.

    Files alternate between the versions. Their names carry the task attempt, so
    a repeated attempt never writes into a file that the manifest names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        number, out, held, rows = 0, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([rows])], names=["file", "records"]
            )

        for batch in batches:
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    version = 1 + (context.partitionId() + number) % 2
                    name = f"{context.partitionId():06d}-{number:06d}-{context.taskAttemptId()}.arc.gz"
                    out, held, rows = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    block = f"{version} 0 tastemill\n{FIELDS[version]}\n\n".encode()
                    line = f"filedesc://{name} 0.0.0.0 {FETCHED} text/plain {len(block)}\n"
                    out.write(gzip.compress(line.encode() + block + b"\n", LEVEL))
                payload = (html or "").encode()
                content = http_block(key, len(payload)) + payload
                line = arc_header(version, safe_url(url), "text/html", len(content), name, out.tell())
                out.write(gzip.compress(line + content + b"\n", LEVEL))
                held, rows = held + len(content), rows + 1
                if held >= FILE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    chosen = pages.select(F.col("page_id").cast("long"), "url", "html")
    return stored(chosen.mapInArrow(write, "file string, records long"), "arc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """Files dealt out over the tasks, one row per file."""
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(tasks, "file")


def _load(store, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


SURVEY = "file string, number long, key long, url string, date string, digest string, size long"


def survey(manifest: DataFrame, folder: str) -> DataFrame:
    """A line per ARC record: its place, key, digest and payload size."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = [
                    (name, i, r.key, r.url, r.date, hashlib.sha1(r.payload).hexdigest(), len(r.payload))
                    for i, r in enumerate(read_arc(_load(store, f"{root}/{name}")))
                ]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                    names=[c.split()[0] for c in SURVEY.split(", ")],
                )

    return _spread(manifest).mapInArrow(read, SURVEY)


def verdicts(lines: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Survey lines with ``first``, the record they revisit (null: they stay).

    Of equal payloads the record with the largest key stays; a record without a
    key comes after all others, and ties go to the later file and place. A digest
    that a large share of records has is aggregated before the shuffle and split
    in the join.
    """
    place = F.struct("key", "file", "number", "url", "date")
    first = (
        lines.where(F.col("size") >= least)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.max(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    found = lines.join(first, (F.col("digest") == F.col("of")) & (F.col("size") >= least), "left")
    same = (F.col("first.file") == F.col("file")) & (F.col("first.number") == F.col("number"))
    revisits = F.col("first").isNotNull() & ~same
    return found.select(
        "file", "number", "digest",
        *[F.when(revisits, F.col(f"first.{c}")).alias(f"to_{c}") for c in ("key", "url", "date")],
        revisits.alias("revisits"),
    )


def record_id(url: str, date: str, key: int | None, digest: str) -> str:
    """The same record always has the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url}|{date}|{key}|{digest}')}>"


def iso(date: str) -> str:
    """ARC's fourteen digits (shorter ones are padded) as WARC's timestamp."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _base32(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.0", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def converted(record: Record, digest: str, to: tuple | None) -> bytes:
    """The WARC record for an ARC record; ``to`` is (key, url, date) of what it revisits."""
    http = bool(record.http)
    kind = "revisit" if to else "response" if http or record.url.startswith("dns:") else "resource"
    block = record.http if to else record.http + record.payload
    headers = [
        ("WARC-Type", kind),
        ("WARC-Target-URI", record.url),
        ("WARC-Date", iso(record.date)),
        ("WARC-Record-ID", record_id(record.url, record.date, record.key, digest)),
        ("WARC-IP-Address", record.ip),
        ("Content-Type", "application/http; msgtype=response" if http else record.mime),
        ("WARC-Payload-Digest", _base32(digest)),
        ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())),
    ]
    if to:
        key, url, date = to
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(url, date, key, digest)),
            ("WARC-Refers-To-Target-URI", url),
            ("WARC-Refers-To-Date", iso(date)),
        ]
    if record.truncated:
        headers.append(("WARC-Truncated", "length"))
    return warc_record(headers, block)


def convert(manifest: DataFrame, arc_folder: str, folder: str) -> DataFrame:
    """Write a WARC file for every ARC file; returns ``(file, records)``.

    A file and the verdicts on its records meet in one group, which the file's
    size bounds.
    """
    decided = verdicts(stored(survey(manifest, arc_folder), "survey"))

    def write(lines: pd.DataFrame) -> pd.DataFrame:
        source, arc = open_store(arc_folder)
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = lines["file"].iloc[0]
        lines = lines.sort_values("number")
        out_name = f"{name.removesuffix('.arc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
        with store.open_output_stream(f"{root}/{out_name}", compression=None) as out:
            info = [
                ("WARC-Type", "warcinfo"),
                ("WARC-Date", iso(FETCHED)),
                ("WARC-Record-ID", record_id(out_name, FETCHED, None, "")),
                ("Content-Type", "application/warc-fields"),
            ]
            out.write(gzip.compress(warc_record(info, f"converted-from: {name}\r\n".encode()), LEVEL))
            records = read_arc(_load(source, f"{arc}/{name}"))
            columns = [lines[c] for c in ("digest", "revisits", "to_key", "to_url", "to_date")]
            for record, digest, revisits, key, url, date in zip(records, *columns):
                to = (None if pd.isna(key) else int(key), url, date) if revisits else None
                out.write(gzip.compress(converted(record, digest, to), LEVEL))
        return pd.DataFrame({"file": [out_name], "records": [len(lines)]})

    # the lines are few bytes, the files behind them are not: keep one task per few files
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = decided.withColumn("to_key", F.col("to_key").cast("string")).repartition(tasks, "file")
    return stored(
        lines.groupBy("file").applyInPandas(write, "file string, records long"), "warc-manifest"
    )


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each record of a WARC file."""
    source = _opened(data)
    while line := source.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        yield headers, source.read(int(headers["Content-Length"]))


READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, id string,"
    " to string"
)


def read_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """Per page, what the WARC files say; digests of responses are computed anew."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_warc(_load(store, f"{root}/{name}")):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    if kind == "revisit":
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        digest = base64.b32decode(digest).hex()
                        size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                    else:
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    key = re.search(rb"%s: (-?[0-9]+)" % KEY_HEADER.encode(), http)
                    rows.append(
                        (int(key[1]) if key else None, size, digest, kind,
                         headers["WARC-Record-ID"], headers.get("WARC-Refers-To"))
                    )
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                    names=[c.split()[0] for c in READ.split(", ")],
                )

    found = stored(_spread(manifest).mapInArrow(read, READ), "warc-records")
    targets = found.where("to is not null").select(F.col("to").alias("target")).distinct()
    targets = found.join(targets, F.col("id") == F.col("target"), "left_semi").groupBy("id").agg(
        F.max("page_id").alias("refers_to")
    )
    return found.join(targets.withColumnRenamed("id", "target"), F.col("to") == F.col("target"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back.

    Null html is an empty payload, a null URL ``about:blank``, a null id a record
    without a key; repeated rows are records of their own, one of which stays a
    response; an empty table gives no rows.
    """
    arcs, warcs = (scratch_folder(pages.sparkSession, k) for k in ("arc", "warc"))
    return read_pages(convert(write_arc(pages, arcs), arcs, warcs), warcs)
