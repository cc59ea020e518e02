"""WARC archives: writing them, and normalising monolithic gzip archives to one member per record.

A monolithic archive is one gzip stream over many records, so no record can be read without inflating all before it. The
normaliser inflates such a file once, as a stream, rewrites every record as a gzip member of its own, and writes a sidecar
index (offset, length, type and page of each member), with which a reader seeks to a record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, resolve, shared_folder, store

MINIMUM_BYTES = 1000
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
GZIP = 31  # zlib's window bits for a gzip header
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL namespace
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def decide(written: DataFrame, minimum_bytes: int = MINIMUM_BYTES) -> DataFrame:
    """written (file, ordinal, page_id, payload_bytes, key) -> file, ordinal, refers_to of the records that are revisits.

    Of records with equal payloads of at least minimum_bytes, those with the largest page_id are responses and the others
    revisit it. Payloads are compared by SHA-256, in narrow rows: the payloads themselves are never shuffled. Groups are
    counted and their largest id found with partial sums, so a payload that a third of all rows share is no hot group.
    """
    large = written.filter(F.col("payload_bytes") >= minimum_bytes)
    groups = large.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    return large.join(groups, "key").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("file", "ordinal", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of its page, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = lambda p: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{p}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: quote(m[0]), url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"Page-Number: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-Number: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def as_revisit(fields: dict[str, str], data: bytes, refers_to: int) -> bytes:
    """A response record as a revisit of the record of another page."""
    block = data.partition(b"\r\n\r\n")[2][: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    page = fields["page-number"]
    return record(int(page) if page else None, fields.get("warc-target-uri"), payload, "revisit", refers_to)


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields of a record by lower-case name, with the version line under an empty one."""
    lines = head.decode().split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(uri: str) -> Iterator[bytes]:
    """The plain bytes of a gzip file, one member or many, in bounded pieces."""
    fs, path = resolve(uri)
    with fs.open_input_stream(path, compression=None) as f:
        z = zlib.decompressobj(GZIP)
        while data := f.read(READ_BYTES):
            while data:
                if z.eof:
                    data = data.lstrip(b"\0")
                    z = zlib.decompressobj(GZIP)
                    continue
                yield z.decompress(data, READ_BYTES * 4)
                data = z.unused_data if z.eof else z.unconsumed_tail
        if not z.eof:
            raise ValueError(f"{uri} ends within a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) of each record in a stream of plain bytes."""
    held, at_end = bytearray(), False
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        end, seen = -1, 0
        while end < 0:
            end = held.find(b"\r\n\r\n", max(0, seen - 3))
            if end < 0:
                seen = len(held)
                if not fill(seen + 1):
                    at_end = True
                    break
        if at_end:
            if bytes(held).strip():
                raise ValueError("a record has no end of header")
            return
        fields = parse_head(bytes(held[:end]))
        if not fields[""].startswith("WARC/"):
            raise ValueError(f"not a record: {fields['']!r}")
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("a record is cut off")
        yield fields, bytes(held[:size])
        del held[:size]


WRITTEN = "file string, ordinal int, page_id long, payload_bytes long, key string"
_WRITTEN = pa.schema([("file", pa.string()), ("ordinal", pa.int32()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("key", pa.string())])


def write_monolithic(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives of one gzip member each, all records responses; a row per record written.

    A task rolls over at file_bytes of plain records, so a file's records are few enough to be listed in one row.
    """
    folder = shared_folder(pages.sparkSession) + "/monolithic"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size, z = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(6, zlib.DEFLATED, GZIP)
                    fs, path = resolve(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                payload = (html or "").encode()
                data = record(page_id, url, payload, "response", None)
                out.write(z.compress(data))
                rows.append((name, n, page_id, len(payload), hashlib.sha256(payload).hexdigest()))
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.write(z.flush())
                    out.close()
                    out = None
            if rows:
                yield _batch(rows, _WRITTEN)
        if out is not None:
            out.write(z.flush())
            out.close()

    return store(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(write, WRITTEN), "written")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


FILES = "file string, sidecar string, n_records long, n_bytes long"
_FILES = pa.schema([("file", pa.string()), ("sidecar", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def normalise(written: DataFrame, revisits: DataFrame) -> DataFrame:
    """Rewrite each monolithic archive with one gzip member per record and a sidecar index; revisits become revisit records.

    A task inflates a file once, as a stream, and holds one record and a few MB of it. The sidecar has a JSON line per member.
    """
    folder = shared_folder(written.sparkSession) + "/archives"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                again = {x["ordinal"]: x["refers_to"] for x in listed or ()}
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, path = resolve(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                n = at = 0
                with fs.open_output_stream(path, compression=None) as out, fs.open_output_stream(f"{path}.index", compression=None) as index:
                    for fields, data in records(inflate(source)):
                        kind = fields["warc-type"]
                        if n in again:
                            kind, data = "revisit", as_revisit(fields, data, again[n])
                        z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        line = {"offset": at, "length": len(member), "type": kind, "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        n, at = n + 1, at + len(member)
                yield _batch([(name, f"{name}.index", n, at)], _FILES)

    files = written.select("file").distinct()
    listed = revisits.groupBy("file").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("revisits"))
    spread = files.join(listed, "file", "left").select("file", "revisits").repartition(partitions(written.sparkSession), F.xxhash64("file"))
    return store(spread.mapInArrow(rewrite, FILES), "archive_files")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_member(member: bytes) -> tuple:
    """A row of RECORDS from one gzip member; checks a response's payload against its digest."""
    data = zlib.decompress(member, GZIP)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = parse_head(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(parse_head(http)["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{fields['warc-record-id']}: the payload isn't what its header says")
    number = lambda x: int(x) if x else None
    return number(fields["page-number"]), size, digest, fields["warc-type"], number(fields.get("refers-to-page-number"))


def read_archives(files: DataFrame) -> DataFrame:
    """Read normalised archives (file, sidecar, ...) member by member, each found through the sidecar index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = resolve(name)
                rows = []
                with fs.open_input_file(path) as f, fs.open_input_stream(resolve(sidecar)[1]) as index:
                    for line in index.read().splitlines():
                        entry = json.loads(line)
                        rows.append(read_member(f.read_at(entry["length"], entry["offset"])))
                        if len(rows) == 4096:
                            yield _batch(rows, _RECORDS)
                            rows = []
                if rows:
                    yield _batch(rows, _RECORDS)

    return files.select("file", "sidecar").repartition(partitions(files.sparkSession), "file").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) written as monolithic archives, normalised, and read back: see RECORDS.

    Null html is an empty payload, null url ``about:blank``. Rows with one page_id and payload are alike: all are responses
    if theirs is the largest id. Payloads whose rows all lack an id are responses. A null page_id is smaller than any other. An empty table gives no rows.
    """
    written = write_monolithic(pages)
    return read_archives(normalise(written, decide(written)))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.last IS NOT NULL AND g.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last IS NOT NULL AND g.last <> p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g USING (html)
"""
