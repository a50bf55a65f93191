"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Each response record gives a ``metadata`` record (application/warc-fields: what the response says of itself) and, if its
payload is markup or text, a ``conversion`` record (text/plain) of the visible text. Both refer to the response by
WARC-Refers-To, and carry its target address, date and payload digest; their own ids follow from the response's id, so
a repeated run makes the same records. Digests are SHA-1 in base 32, as usual in WARC files.

A response whose block is null has an empty block; null addresses and dates leave their header out. A block that isn't
HTTP is taken as a payload without headers. Null ids are told apart by nothing but their content. Repeated rows give
repeated records. Very long html is converted whole. Other columns are ignored. Empty tables give none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "source_id {0}, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_status int, source_content_type string, source_payload_digest string, block_digest string, content_length long, block binary"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_DROP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title\s*>")
_BREAK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>")
_TAG = re.compile(r"</?[A-Za-z][^>]*>")
_CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def parse_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers (lower-case names; the last of equal ones) and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None, {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    status = re.match(r"HTTP/\S+\s+(\d{3})\b", first)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return int(status[1]) if status else None, headers, body


def decode(payload: bytes, content_type: str) -> str:
    named = _CHARSET.search(content_type) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def visible_text(markup: str) -> str:
    """The title and the text between tags, a line for each block; scripts, styles and comments are left out."""
    title = _TITLE.search(markup)
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub("\n", markup)))
    text = html.unescape((title[1] if title else "") + "\n" + text)
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def derive(rid: str, uri: str | None, date: str | None, block: bytes) -> Iterator[tuple]:
    """The records of one response, as tuples of the columns after source_id."""
    status, headers, payload = parse_http(block)
    kind = headers.get("content-type", "")
    source = digest(payload)
    fields = {"http-status": status, **{f"http-{k}": headers[k] for k in sorted(headers)}, "payload-length": len(payload), "payload-digest": source}
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode())]
    plain = kind.split(";")[0].strip().lower()
    if plain in ("", "text/html", "application/xhtml+xml", "text/plain"):
        text = decode(payload, kind)
        made.append(("conversion", "text/plain; charset=utf-8", (text if plain == "text/plain" else visible_text(text)).encode("utf-8", "replace")))
    for what, content_type, data in made:
        yield what, record_id(rid, what), rid, uri, date, content_type, status, kind or None, source, digest(data), len(data), data


def derivatives(responses: DataFrame) -> DataFrame:
    """Records (RECORD) of responses (source_id, record_id, target_uri, date, block)."""

    def run(batches):
        for b in batches:
            rows = []
            for sid, rid, uri, date, block in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(sid, *r) for r in derive(rid or "", uri, date, block or b"")]
            cols = list(zip(*rows)) or [[]] * len(_NAMES)
            types = [b.column(0).type] + [pa.string()] * 6 + [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], _NAMES)

    kind = responses.schema["source_id"].dataType.simpleString()
    return responses.select("source_id", "record_id", "target_uri", "date", F.col("block").cast("binary")).mapInArrow(run, RECORD.format(kind))


def responses(pages: DataFrame, page_id: str = "page_id", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of raw pages (page_id, url, html) that were kept without their HTTP headers."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    ident = F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat_ws("\n", F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))), F.lit(">"))
    return pages.select(F.col(page_id).alias("source_id"), ident.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(F.lit(head), F.coalesce("html", F.lit(""))).alias("block"))


def to_warc(record: dict) -> bytes:
    """A record in WARC 1.1 form."""
    head = {
        "WARC-Type": record["record_type"], "WARC-Record-ID": record["record_id"], "WARC-Refers-To": record["refers_to"], "WARC-Target-URI": record["target_uri"], "WARC-Date": record["date"],
        "WARC-Block-Digest": record["block_digest"], "WARC-Refers-To-Payload-Digest": record["source_payload_digest"], "Content-Type": record["content_type"], "Content-Length": record["content_length"],
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + record["block"] + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes one .warc.gz file a partition, each record a gzip member of its own; (path, records) of the files when the
    result is used. Files appear under their name only when complete, so a repeated task does no harm."""
    from .seekable import store

    def put(batches):
        from pyspark import TaskContext

        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        name, n = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        tmp = f"{base}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp, compression=None) as out:
            for b in batches:
                for r in b.to_pylist():
                    out.write(gzip.compress(to_warc(r), mtime=0))
                    n += 1
        fs.move(tmp, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "records"])

    return records.mapInArrow(put, "path string, records long")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return made.select(F.col("source_id").alias("page_id"), *_NAMES[1:-1], F.decode("block", "utf-8").alias("block"))


QUERIES = {"op6_warc_derivatives": op6_warc_derivatives}
SQL: dict[str, str] = {}
