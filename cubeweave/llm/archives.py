"""Legacy web archives: ARC files read by their declared lengths and converted to WARC (op 9)."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeweave.llm._scratch import fresh_path, materialise, released_shuffles

#: Capture times are not known of pages; records take this date.
CAPTURED = "20200101000000"
#: About so many payload bytes make one archive of its own inside a file.
SEGMENT_BYTES = 4_000_000
#: Of zlib's levels, a fast one: a tenth more bytes for a quarter of the time.
GZIP_LEVEL = "TWO"
#: Columns of a URL record, by the version that an archive's first record declares.
ARC_COLUMNS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID_SPACE = uuid.UUID("6f2c1a52-7c0e-4c8e-9a55-0d6d8f3b1e77")
_END = b"\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, page: str) -> str:
    """A WARC identifier that depends on the record alone, so a task that runs again writes the same."""
    return f"<urn:uuid:{uuid.uuid5(_ID_SPACE, f'{page} {url}')}>"


def arc_url(url: str | None) -> str:
    """A URL without white space or control characters, as ARC lines need; a null is a placeholder."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"


def http_block(page: str, body: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def arc_segment(version: int, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC archive of (page, url, body) records in the given version, with its version block."""
    columns = ARC_COLUMNS[version]
    block = f"{version} 0 cubeweave\n{' '.join(columns)}\n".encode()
    values = {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "pages.arc"}

    def line(own: dict[str, str]) -> bytes:
        return " ".join((values | own)[c] for c in columns).encode() + b"\n"

    out = [line({"Archive-length": str(len(block))}), block, b"\n"]
    at = sum(map(len, out))
    for page, url, body in records:
        content = http_block(page, body)
        head = line({"URL": arc_url(url), "Content-type": "text/html", "Checksum": sha1_base32(body), "Offset": str(at), "Archive-length": str(len(content))})
        out += [head, content, b"\n"]
        at += len(head) + len(content) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of ARC bytes: the columns of their header line by name, and ``content``.

    A ``filedesc://`` record declares the version and the columns of the lines
    after it, until the next one.  Lengths are the declared ones; content is never
    searched.
    """
    at, columns = 0, ARC_COLUMNS[1]
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode().rstrip("\r").split(" ")
        at = end + 1
        first = fields[0].startswith("filedesc://")
        length = int(fields[-1])
        content = data[at : at + length]
        if len(content) != length:
            raise ValueError("an ARC record ends before its declared length")
        at += length
        if first:
            said, names = content.split(b"\n")[:2]
            version = int(said.split(b" ")[0])
            if version not in ARC_COLUMNS:
                raise ValueError(f"ARC version {version} is unknown")
            columns = tuple(names.decode().strip().split(" "))
            continue
        if len(fields) != len(columns):
            raise ValueError(f"an ARC line has {len(fields)} fields of {len(columns)}")
        yield dict(zip(columns, fields, strict=True)) | {"content": content}


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """An HTTP response's head, its header fields (names in lower case) and its body."""
    head, mark, body = block.partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return head + mark, {k.lower(): v for k, v in fields.items()}, body


def warc_time(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(kind: str, rid: str, url: str, date: str, block: bytes, payload_digest: str, refers_to: str | None, refers_page: str | None = None) -> bytes:
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Target-URI", url), ("WARC-Date", warc_time(date)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to:
        fields[4:4] = [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", refers_page or "")]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of WARC bytes: header fields (names in lower case) and block, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(_END, at)
        lines = data[at:end].decode().split("\r\n")
        if not re.fullmatch(r"WARC/1\.\d", lines[0]):
            raise ValueError("no WARC record where one should begin")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != _END:
            raise ValueError("a WARC record's length isn't the declared one")
        at = end + 8 + n
        yield fields, block


def opened(content: bytes) -> bytes:
    """A file's bytes, of one or more gzip members or plain."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out) if out else content


def _files(df: DataFrame, path: str, end: str) -> None:
    """Write one text column as files whose rows end in ``end``, each file of bounded size."""
    df.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("maxRecordsPerFile", 4000).text(path)


def _read_files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write pages as legacy ARC archives, every other one in version 1 and in version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = 0, [], 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([arc_segment(1 + made % 2, held)], pa.binary())], ["value"])

        for batch in batches:
            for page, url, body in zip(*(batch.column(c) for c in range(3)), strict=True):
                body = body.as_py() or b""
                held.append((page.as_py() or "", url.as_py(), body))
                size += len(body)
                if size >= SEGMENT_BYTES:
                    yield segment()
                    made, held, size = made + 1, [], 0
        if held:
            yield segment()

    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").cast("binary").alias("payload"))
    archives = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # One segment is one row, so a file holds few of them.
    archives.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("maxRecordsPerFile", 2).text(path)


RECORD_SCHEMA = "page string, url string, date string, head binary, body binary, payload_digest string, rid string"


def arc_records(spark, path: str) -> DataFrame:
    """The records of all ARC files below ``path``, with synthesised WARC identifiers and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for r in read_arc(opened(content.as_py())):
                    head, fields, body = split_http(r["content"])
                    page = fields.get("x-page-id", "")
                    rows.append((page, r["URL"], r["Archive-date"], head, body, sha1_base32(body), record_id(r["URL"], page)))
                    size += len(body)
                    if size > SEGMENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    return _read_files(spark, path).mapInArrow(run, RECORD_SCHEMA)


def convert(spark, arc_path: str, warc_path: str, numeric_ids: bool = True) -> None:
    """Convert all ARC archives below ``arc_path`` to WARC files below ``warc_path``.

    Records of equal payload digest: the one of the largest page id is a response,
    the others are revisits that hold no payload again; they refer to it by its
    identifier and, in a field of their own, by its page.
    """
    records = arc_records(spark, arc_path)
    order = F.col("page").cast("decimal(38,0)") if numeric_ids else F.col("page")
    slim = materialise(records.select("page", order.alias("ord"), "payload_digest", "rid"), "arc-index")
    kept = slim.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ord", "rid", "page")).alias("last")).where("n > 1").select(F.col("payload_digest").alias("k_digest"), F.col("last.rid").alias("k_rid"), F.col("last.page").alias("k_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                again = row["k_rid"] is not None and row["k_rid"] != row["rid"]
                block = row["head"] if again else row["head"] + row["body"]
                out.append(warc_record("revisit" if again else "response", row["rid"], row["url"], row["date"], block, row["payload_digest"], row["k_rid"] if again else None, row["k_page"]))
                size += len(out[-1])
                if size > SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    joined = records.join(kept, F.col("payload_digest") == F.col("k_digest"), "left").select("url", "date", "head", "body", "payload_digest", "rid", "k_rid", "k_page")
    # The row's end is the two line ends that close a WARC record.
    _files(joined.mapInArrow(run, "value binary").select(F.col("value").cast("string")), warc_path, "\r\n\r\n")


INDEX_SCHEMA = "page string, payload_bytes bigint, payload_digest string, record_type string, refers_page string"


def warc_index(spark, path: str) -> DataFrame:
    """Read all WARC files below ``path`` back; digests of stored blocks and payloads are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in read_warc(opened(content.as_py())):
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    _, http, body = split_http(block)
                    stored = fields["warc-type"] == "response"
                    if f"sha1:{sha1_base32(block)}" != fields["warc-block-digest"] or stored and sha1_base32(body) != digest:
                        raise ValueError(f"record {fields['warc-record-id']} differs from its digest")
                    rows.append((http["x-page-id"], len(body) if stored else int(http["content-length"]), digest, fields["warc-type"], fields.get("x-refers-to-page")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    return _read_files(spark, path).mapInArrow(run, INDEX_SCHEMA)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """Write pages as ARC, convert the archives to WARC and read those back.

    Both archives stay below ``path`` (by default a new folder in the shared folder).

    Returns per row: ``id_col``, payload_bytes, payload_digest (bare base32
    SHA-1), record_type (response or revisit) and refers_to (the response's id
    for revisits, else null).

    A null payload is an empty one, and empty payloads are equal ones; a null or
    odd URL is stored escaped.  Rows that agree in id, URL and payload have one
    record id: each is written and returned, as a response where it is the last.
    An empty table gives an empty result.  Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archives")
    kind = pages.schema[id_col].dataType
    with released_shuffles(spark):
        write_arc(pages, f"{path}/arc", id_col, url_col, payload_col)
        convert(spark, f"{path}/arc", f"{path}/warc", isinstance(kind, T.IntegralType))
    found = warc_index(spark, f"{path}/warc")
    back = lambda c: F.nullif(F.col(c), F.lit("")).cast(kind)
    return found.select(back("page").alias(id_col), "payload_bytes", "payload_digest", "record_type", back("refers_page").alias("refers_to"))
