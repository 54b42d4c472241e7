"""ARC to WARC: reads legacy archives of version 1 and 2 and writes WARC 1.1 records.

An ARC file begins with a version block, whose own header names the fields of all later header lines. A record is a
header line, the declared number of bytes, a newline. The last fields of a line are fixed in number, so a URL may hold
blanks. From a record the converter makes a WARC record: an identifier (name-based, so a second run gives the same one),
the 14-digit date as an ISO timestamp, the type (warcinfo for the version block, response for HTTP, resource for the
rest) and SHA-1 digests of the block and of the payload. Of records with equal payloads of min_bytes and more one stays
a response, by the greatest order key; the others become revisits that refer to its identifier.

Archives are written by Spark's text writer, a record to a line that ends in two CRLFs, gzipped by file, in a folder
that only Spark needs to reach. They are read back by Spark's text reader, as parts that end in two CRLFs, which are put
together again by declared lengths: no task holds more than a record.

Defined results: a null page has an empty payload. Records of equal order keys and payloads, repeated rows among them: the one with
the greatest identifier is the response. Identifiers differ even then, as archives are named by the partition that writes them. A null order key is the smallest. Payloads are kept whole. Empty tables give no records.
A declared length beyond the end of the file raises ValueError, as does an unknown version.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.session import arrow_batches, shared_dir

MIN_BYTES = 1000
ARC_BYTES = 4 << 20
RECORDS_PER_FILE = 20_000
CRLF = b"\r\n"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-record")
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
RECORD = "page_id bigint, record_id string, target_uri string, date string, type string, content_type string, ip string, head binary, payload binary, payload_digest string, payload_bytes bigint, block_digest string"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes
    offset: int


# --- ARC ---------------------------------------------------------------------------------------------------------------


def write_arc(name: str, version: int, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, body) records."""
    names = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
    if version == 2:
        names = (*names[:4], "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
    block = f"{version} {'0 origin' if version == 1 else '0 reserved origin'}\n{' '.join(names)}\n".encode()
    out, size = [], 0

    def add(url: str, ip: str, date: str, kind: str, body: bytes) -> None:
        nonlocal size
        middle = "" if version == 1 else f"200 {base64.b32encode(hashlib.sha1(body).digest()).decode()} - {size} {name} "
        out.append(f"{url} {ip} {date} {kind} {middle}{len(body)}\n".encode() + body + b"\n")
        size += len(out[-1])

    add(f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", block)
    for r in records:
        add(*r)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] == b"\n":  # some writers leave more than one newline between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of header line at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc:")
        # the version block's header line is as the version's lines are; the fields from the right say which it is
        names = fields
        if first:
            names = FIELDS[2] if len(line.split(" ")) >= len(FIELDS[2]) else FIELDS[1]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not a header line at byte {at}: {line[:80]!r}")
        got = dict(zip(names, values, strict=True))
        start, size = end + 1, int(got["length"])
        if start + size > len(data):
            raise ValueError(f"a record at byte {at} declares {size} bytes; the file has {len(data) - start} left")
        body = data[start : start + size]
        if first:
            version = body.split(b" ", 1)[0].decode("ascii", "replace")
            if version not in ("1", "2"):
                raise ValueError(f"unknown version {version!r}")
            fields = FIELDS[int(version)]
        yield ArcRecord(got, body, at)
        at = start + size + 1


# --- conversion --------------------------------------------------------------------------------------------------------


def timestamp(date: str) -> str:
    """14 digits, or the first of them, as an ISO timestamp in UTC."""
    full = date + "00000101000000"[len(date) :] if len(date) < 14 else date[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(archive: str, offset: int, url: str, date: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {offset} {date} {url}')}"


def _header(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(CRLF):
        if line[: len(name) + 1].lower() == name.lower() + b":":
            return line[len(name) + 1 :].strip()
    return None


def convert(arcs: DataFrame, payload: bool = True) -> DataFrame:
    """Records (RECORD) of ARC files given as (name, content); without payload only its digest and size are returned."""
    fields = RECORD if payload else RECORD.replace("head binary, payload binary, ", "")
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = {f.split(" ")[0]: kinds[f.split(" ")[1]] for f in RECORD.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns: dict[str, list] = {c: [] for c in names}
                for r in read_arc(data):
                    f, head, body = r.fields, b"", r.body
                    kind = "warcinfo" if f["url"].startswith("filedesc:") else "resource"
                    if f["url"].lower().startswith(("http:", "https:")) and body.startswith(b"HTTP/"):
                        kind = "response"
                        cut = body.find(b"\r\n\r\n")
                        head, body = (body[: cut + 4], body[cut + 4 :]) if cut >= 0 else (body, b"")
                    page = _header(head, b"X-Page-Id")
                    row = {
                        "page_id": int(page) if page else None, "record_id": record_id(name, r.offset, f["url"], f["date"]), "target_uri": f["url"],
                        "date": timestamp(f["date"]), "type": kind, "content_type": f["type"], "ip": f["ip"], "head": head, "payload": body,
                        "payload_digest": hashlib.sha1(body).hexdigest(), "payload_bytes": len(body), "block_digest": hashlib.sha1(r.body).hexdigest(),
                    }
                    for c in names:
                        columns[c].append(row[c])
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) for c in names], names)

    arrow_batches(arcs.sparkSession)
    return arcs.select("name", "content").mapInArrow(run, fields)


def mark_revisits(records: DataFrame, slim: DataFrame, min_bytes: int = MIN_BYTES, order: str = "page_id") -> DataFrame:
    """records with type revisit and refers_to where an equal payload has a greater order key. slim: the records without payload."""
    equal = (
        slim.where((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes))
        .groupBy("payload_digest")
        .agg(F.max(F.struct(order, "record_id", "target_uri", "date")).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", "best")
    )
    # a payload that a third of all records share is one row on the right; Spark splits such a join by itself. Small payloads
    # have no partner: they are dealt out by their identifiers, as very many may be empty.
    key = F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")).otherwise(F.col("record_id"))
    joined = records.withColumn("_digest", key).join(equal.withColumnRenamed("payload_digest", "_digest"), "_digest", "left").drop("_digest")
    other = (F.col("type") == "response") & F.col("best").isNotNull() & (F.col("best.record_id") != F.col("record_id"))
    return joined.withColumns({"refers": F.when(other, F.col("best")), "type": F.when(other, F.lit("revisit")).otherwise(F.col("type"))}).drop("best")


# --- WARC --------------------------------------------------------------------------------------------------------------


def _sha1(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _warc(row: dict) -> bytes:
    """A record without the two CRLFs that end it."""
    kind, block = row["type"], row["head"] + row["payload"]
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {row['target_uri']}", f"WARC-IP-Address: {row['ip']}", f"WARC-Payload-Digest: {_sha1(row['payload_digest'])}"]
    digest = row["block_digest"]
    if kind == "revisit":
        to = row["refers"]
        block = row["head"]
        digest = hashlib.sha1(block).hexdigest()
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{to['record_id']}>",
            f"WARC-Refers-To-Target-URI: {to['target_uri']}", f"WARC-Refers-To-Date: {to['date']}", "WARC-Truncated: length",
        ]
    media = {"warcinfo": "text/plain", "resource": row["content_type"]}.get(kind, "application/http; msgtype=response")
    lines += [f"WARC-Block-Digest: {_sha1(digest)}", f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block


def write_warcs(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Gzipped WARC files of at most per_file records in the folder path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                yield pa.RecordBatch.from_arrays([pa.array([_warc(r) for r in batch.slice(a, 512).to_pylist()], pa.binary())], ["value"])

    # bytes go through a string column as they are
    made = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of WARC files, given in parts of any size, by declared lengths."""
    held = bytearray()

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        while held[:2] == CRLF or len(held) < 2:
            if held[:2] == CRLF:
                del held[:2]
            elif not more():
                if held:
                    raise ValueError("bytes after the last record")
                return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a WARC header has no end")
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("a WARC record is cut off")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        yield headers, block


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_id, type, payload_bytes, payload_digest, refers_id) of every response and revisit."""
    names = ["page_id", "record_id", "type", "payload_bytes", "payload_digest", "refers_id"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[bytes]:
            for batch in batches:
                for value in batch.column(0):
                    yield value.as_py() + CRLF + CRLF

        def rows() -> Iterator[tuple]:
            for headers, block in parse_warc(parts()):
                if headers["warc-type"] not in ("response", "revisit"):
                    continue
                cut = block.find(b"\r\n\r\n")
                head, payload = block[: cut + 4], block[cut + 4 :]
                page = _header(head, b"X-Page-Id")
                declared = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                if headers["warc-type"] == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if digest != declared:
                        raise ValueError(f"the payload of {headers['warc-record-id']} isn't what its digest says")
                else:
                    size, digest = int(_header(head, b"Content-Length") or 0), declared
                refers = headers.get("warc-refers-to")
                yield int(page) if page else None, headers["warc-record-id"].strip("<>"), headers["warc-type"], size, digest, refers and refers.strip("<>")

        every = rows()
        while some := list(islice(every, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(types)], names)

    arrow_batches(spark)
    files = spark.read.option("lineSep", "\r\n\r\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("value"))
    return files.mapInArrow(run, "page_id bigint, record_id string, type string, payload_bytes bigint, payload_digest string, refers_id string")


# --- pages -------------------------------------------------------------------------------------------------------------


def pages_to_arcs(pages: DataFrame, arc_bytes: int = ARC_BYTES, date: str = "20240101000000") -> DataFrame:
    """(name, content): ARC files of about arc_bytes, of version 1 and 2 in turn, made of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, str, str, bytes]] = []
        size, made = 0, 0
        part = TaskContext.get().partitionId()

        def file() -> pa.RecordBatch:
            nonlocal held, size, made
            version = 1 + made % 2
            # named by its place and by what it holds, so a second run gives the same names, and equal rows elsewhere have others
            what = hashlib.md5(b"".join(hashlib.md5(r[0].encode() + r[4]).digest() for r in held)).hexdigest()
            name = f"pages-{part}-{what}-{made}.arc"
            data = write_arc(name, version, held)
            held, size, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["name", "content"])

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                who = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{who}Content-Length: {len(payload)}\r\n\r\n"
                address = "".join((url or "").split())
                held.append((address if address.lower().startswith(("http:", "https:")) else f"http://unknown.invalid/{address}", "0.0.0.0", date, "text/html", head.encode() + payload))
                size += len(payload) + 500
                if size >= arc_bytes:
                    yield file()
        if held:
            yield file()

    return pages.select("page_id", "url", "html").mapInArrow(run, "name string, content binary")


def op3_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = pages_to_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    marked = mark_revisits(convert(arcs).where("type <> 'warcinfo'"), convert(arcs, payload=False))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warcs(marked, path)
    read = read_warcs(spark, path)
    revisits = read.where("type = 'revisit'").select("record_id", "refers_id")
    targets = read.where("type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    named = revisits.join(targets, "refers_id").select("record_id", "refers_to")
    return read.join(named, "record_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("refers_to")).alias("refers_to")
    )
