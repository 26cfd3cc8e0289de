"""ARC archives, their conversion to WARC, and reading WARC back.

An ARC file begins with a version block whose second line states the version
and whose third line names the fields of the header lines; each record is a
header line, whose last field is the declared length, and so many bytes. The
converter reads both versions, record by record by the declared lengths, and
synthesises what WARC wants beside: record identifiers (from archive and
offset), timestamps in its format, record types, block and payload digests.
Records that repeat a payload become revisits of one of them.

Files are written by Spark's text sink (a record is a "line" of bytes, the
separator is what the format puts between records) and read as whole files, so
any store that Spark reaches will do. A file is what one task wrote: the size
of an input split. Times are UTC.
"""

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeykit.llm.storage import saved, shared_path, small_side

#: Names of the header fields of both versions, in their order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id"
RECORD_SCHEMA = ("record_id string, page_id long, url string, ip string, date string, mime string, digest string, "
                 "payload_bytes long, head binary, payload binary")


def http_block(page_id: int | None, payload: bytes) -> bytes:
    page = b"" if page_id is None else PAGE_HEADER + b": %d\r\n" % page_id
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n" % len(payload)
            + page + b"\r\n" + payload)


def split_http(block: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """Header part (with its empty line), payload, and header fields by lower-case name."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return head + gap, payload, {k.strip().lower(): v.strip() for k, v in fields.items()}


def arc_header(version: int, url: str | None, ip: str, date: str, mime: str, body: bytes, offset: int) -> bytes:
    url = urllib.parse.quote(url or "-", safe="%/:=&?~#+!$,;'@()*[]-._")
    middle = f"200 {hashlib.md5(body).hexdigest()} - {offset} - " if version == 2 else ""
    return f"{url} {ip} {date} {mime} {middle}{len(body)}\n".encode()


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 journeykit\n{ARC_FIELDS[version]}\n".encode()
    middle = "200 - - 0 - " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(body)}\n".encode() + body


def _lines(records, size: int = 256):
    """Record bytes in Arrow batches of bounded size."""
    batch, held = [], 0
    for record in records:
        batch.append(record)
        held += len(record)
        if len(batch) >= size or held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.binary())], ["value"])
            batch, held = [], 0
    if batch:
        yield pa.RecordBatch.from_arrays([pa.array(batch, pa.binary())], ["value"])


def _write(lines: DataFrame, path: str, separator: str) -> None:
    lines.select(F.col("value").cast("string").alias("value")).write.text(path, compression="gzip", lineSep=separator)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = "20240101000000", ip: str = "0.0.0.0") -> None:
    """An ARC record per row: the html in UTF-8 (null: empty) behind an HTTP
    header. Even partitions write version 1, odd ones version 2. A null URL is
    written as ``-``; what a URL may not hold is percent-encoded."""
    def records(batches, version):
        begin = version_block(version, "pages.arc", date)
        yield begin
        offset = len(begin) + 1
        for batch in batches:
            ids, urls, bodies = (batch.column(i).to_pylist() for i in range(3))
            for page_id, url, html in zip(ids, urls, bodies):
                block = http_block(page_id, html or b"")
                record = arc_header(version, url, ip, date, "text/html", block, offset) + block
                offset += len(record) + 1
                yield record

    def task(batches):
        from pyspark import TaskContext
        yield from _lines(records(batches, 1 + TaskContext.get().partitionId() % 2))

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("binary"))
    _write(rows.mapInArrow(task, "value binary"), path, "\n")


def gunzip(content: bytes) -> bytes:
    """All members of a gzip file; other content as it is."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out) + content


def parse_arc(data: bytes, skip_damaged: bool = False):
    """(offset, fields, block) of each record after the version block. The
    header lines are read by the version that the block states; a length that
    runs past the end, or a header line with too few fields, raises. With
    ``skip_damaged`` the next line that is a header with a date and a length
    that fits is looked for instead, and what lies between is left out."""
    def header(at: int, names: list[str]):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        # From the right: an old URL, the first field, may hold spaces.
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
        if len(values) < len(names) or not values[-1].isdecimal():
            raise ValueError(f"no ARC header line of {len(names)} fields at byte {at}")
        fields = dict(zip(names, values))
        stop = end + 1 + int(fields[names[-1]])
        if stop > len(data):
            raise ValueError(f"ARC record at byte {at} declares {fields[names[-1]]} bytes; the file ends before")
        return fields, end + 1, stop

    if not data:
        return
    first = data[:data.index(b"\n")].split(b" ")
    begin = data.index(b"\n") + 1
    version = int(data[begin:begin + data[begin:].index(b" ")])
    if version not in ARC_FIELDS or not first[0].startswith(b"filedesc://"):
        raise ValueError("not an ARC file of version 1 or 2")
    names = ARC_FIELDS[version].split(" ")
    at = begin + int(first[-1])
    while True:
        while data[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        try:
            fields, start, stop = header(at, names)
            sound = len(fields["Archive-date"]) == 14 and fields["Archive-date"].isdecimal()
            if skip_damaged and not sound:
                raise ValueError(f"no date in the ARC header line at byte {at}")
        except ValueError:
            if not skip_damaged:
                raise
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
            continue
        yield at, fields, data[start:stop]
        at = stop


def read_arc(spark: SparkSession, path: str, payloads: bool = True, skip_damaged: bool = False) -> DataFrame:
    """The records of all ARC files under ``path``: ``record_id, page_id, url,
    ip, date, mime, digest, payload_bytes, head, payload`` (``head`` and
    ``payload`` null without ``payloads``). Identifiers come from the archive's
    full path and the offset, so reading again gives the same, and archives of
    one name in several folders differ. Damage raises, or is skipped as
    ``parse_arc`` states."""
    def task(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for offset, fields, block in parse_arc(gunzip(content), skip_damaged):
                    head, payload, http = split_http(block)
                    page = http.get(PAGE_HEADER.lower())
                    url = None if fields["URL"] == "-" else fields["URL"]
                    rows.append((f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}",
                                 None if page is None else int(page), url, fields["IP-address"],
                                 fields["Archive-date"], fields["Content-type"], hashlib.sha1(payload).hexdigest(),
                                 len(payload), head if payloads else None, payload if payloads else None))
                    if len(rows) >= 1000:
                        yield _records(rows)
                        rows = []
                yield _records(rows)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(task, RECORD_SCHEMA)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(),
             pa.binary(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 10, kinds)],
                                      names)


def warc_date(date14: str) -> str:
    return datetime.strptime(date14[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *fields,
             ("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n").encode() + block


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 1000,
                skip_damaged: bool = False) -> None:
    """Write WARC files for all ARC files under ``arc_path``.

    Of the records with equal payloads of at least ``min_revisit_bytes``, that
    with the largest page id (then record id; null ids first) is a response
    and the others are revisits of it, which keep the HTTP header and the full
    payload's digest and length but not the payload. The first pass reads
    digests only; the payloads are read once, by the pass that writes.
    """
    light = read_arc(spark, arc_path, False, skip_damaged).where(F.col("payload_bytes") >= min_revisit_bytes)
    ranked = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record_id", "url", "date")
    chosen = saved(light.groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(ranked).alias("to"))
                   .where("n > 1").select("digest", "payload_bytes", "to.record_id", "to.url", "to.date"), "revisited")
    chosen = chosen.select("digest", "payload_bytes", *[F.col(c).alias(f"to_{c}") for c in ("record_id", "url", "date")])

    def records(batches):
        yield warc_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("Content-Type", "application/warc-fields")],
                          b"software: journeykit\r\nformat: WARC File Format 1.1\r\n")
        for batch in batches:
            for r in batch.to_pylist():
                repeat = r["to_record_id"] is not None and r["to_record_id"] != r["record_id"]
                fields = [("WARC-Date", warc_date(r["date"])), ("WARC-Target-URI", r["url"]),
                          ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", base32(r["digest"]))]
                if repeat:
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{r['to_record_id']}>"),
                               ("WARC-Refers-To-Target-URI", r["to_url"]),
                               ("WARC-Refers-To-Date", warc_date(r["to_date"]))]
                fields.append(("Content-Type", "application/http; msgtype=response"))
                yield warc_record("revisit" if repeat else "response", r["record_id"], fields,
                                  r["head"] + (b"" if repeat else r["payload"]))

    rows = read_arc(spark, arc_path, True, skip_damaged).join(small_side(chosen, chosen.count()), ["digest", "payload_bytes"], "left")
    _write(rows.mapInArrow(lambda batches: _lines(records(batches)), "value binary"), warc_path, "\r\n\r\n")


def parse_warc(data: bytes):
    """(fields by lower-case name, block) of each record, by the stated lengths."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        begin, length = stop + 4, int(fields["content-length"])
        if begin + length > len(data):
            raise ValueError(f"WARC record at byte {at} declares {length} bytes; the file ends before")
        yield fields, data[begin:begin + length]
        at = begin + length
        while data[at:at + 2] == b"\r\n":
            at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of all WARC files under ``path``:
    ``record_id, page_id, url, record_type, payload_digest`` (bare hex),
    ``payload_bytes, refers_to_record``. A response's digest and length are
    taken from the payload that was read, and must be those its header states;
    a revisit's from its headers."""
    def task(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse_warc(gunzip(content)):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    _, payload, http = split_http(block)
                    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size, page = int(http[b"content-length"]), http.get(PAGE_HEADER.lower())
                    if fields["warc-type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, stated):
                        raise ValueError(f"record {fields['warc-record-id']} is damaged")
                    to = fields.get("warc-refers-to")
                    rows.append((fields["warc-record-id"][1:-1], None if page is None else int(page),
                                 fields.get("warc-target-uri"), fields["warc-type"], stated, size, to and to[1:-1]))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [
                    "record_id", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to_record"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(
        task, "record_id string, page_id long, url string, record_type string, payload_digest string, "
              "payload_bytes long, refers_to_record string")


def pages_through_archives(pages: DataFrame, **names) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC, read back: one row per page,
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A null html is an empty payload, a null page id stays null and is never
    referred to where another id has the payload; rows that repeat a page id
    are records of their own (all but one revisit it if the payload is large
    enough). An empty table gives an empty result."""
    spark = pages.sparkSession
    arcs, warcs = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arcs, **names)
    convert_arc(spark, arcs, warcs)
    records = saved(read_warc(spark, warcs), "warc-records")
    targets = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    revisits = records.where("refers_to_record is not null").join(targets, "refers_to_record", "left")
    plain = records.where("refers_to_record is null").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
