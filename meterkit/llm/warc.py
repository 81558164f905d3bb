"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response is a row of (record_id, target_uri, date, block), the block being the HTTP message as
bytes. Each response gives a metadata record (the source's status and headers, its digests, title,
and the conversion it belongs to) and a conversion record (the visible text, one line per text
block). Both refer to the response by WARC-Refers-To and keep its target and date. The WARC headers
of a response that was read from a file (stated digests, addresses, concurrent records) go into its
metadata as source-warc-... fields; digests of the block and payload as stored are computed besides.
Chunked transfer and gzip or deflate encoding are undone before the text is read. Record ids are
name-based UUIDs of the response's id and the kind of record, so a job that runs again gives the
same records. Digests are sha1 in base32, as usual in WARC files.

Defined cases: null html is an empty payload; a null url leaves WARC-Target-URI out; a null id is
named by url and payload alone. Rows are converted one by one: repeated rows get equal records, an
empty table gives an empty result. A payload that is not encoded as its headers say is read as it
is, a broken one as far as it goes; one in another encoding (br, zstd) has no text unless it is
UTF-8 as it stands. A block without an HTTP head is all payload. Line ends within
header values become spaces. A record whose stated length is missing or no number reaches to the next
record. A very long page is one record, held whole by its task. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meterkit.llm.common import blocks, map_arrow
from meterkit.llm.htmltext import text_blocks

DATE = "1970-01-01T00:00:00Z"  # of pages that come without one
LINE = "\r\n"
_NAMES = uuid.UUID("6f1b0b5e-6c1f-5c33-9d43-2f0f1f1d7a10")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\b|\Z)", re.S | re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)

RESPONSE = "record_id string, target_uri string, date string, block binary"
DERIVED = (
    "response_id string, record_type string, record_id string, target_uri string, content_type string, "
    "content_length long, block_digest string, source_block_digest string, source_payload_digest string, record binary"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(*parts: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMES, chr(0).join(parts))}"


def _line(value: str) -> str:
    return " ".join(value.split())


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP message."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
    return status, pairs, payload


_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,16})[ \t]*(?:;[^\r\n]*)?\r\n")


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while m := _CHUNK.match(data, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        at = m.end() + size
        if at < len(data) and not b"\r\n".startswith(data[at : at + 2]):
            break
        out.append(data[m.end() : at])
        at += 2
    return b"".join(out) if out else data


def inflated(data: bytes, kinds: tuple[int, ...]) -> bytes:
    """``data`` decompressed by the first of zlib's window kinds that fits, all members of it."""
    for kind in kinds:
        out, rest, whole = [], data, False
        while rest:
            z, at = zlib.decompressobj(kind), 0
            try:
                while at < len(rest) and not z.eof:
                    out.append(z.decompress(rest[at : at + 65536]))
                    at += 65536
            except zlib.error:
                break
            whole |= z.eof
            rest = z.unused_data + rest[at:] if z.eof else b""
        if whole or any(out):
            return b"".join(out)
    return data


def content(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content encodings."""
    listed = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",")]
    for kind in [*listed("transfer-encoding")[::-1], *listed("content-encoding")[::-1]]:
        if kind == "chunked":
            payload = unchunked(payload)
        elif kind in ("gzip", "x-gzip"):
            payload = inflated(payload, (31,))
        elif kind == "deflate":
            payload = inflated(payload, (15, -15))
        elif kind not in ("", "identity"):
            try:
                payload.decode()
            except UnicodeDecodeError:
                return b""
    return payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    """The payload as text, by the declared character set, else UTF-8."""
    declared = next((v for k, v in headers if k.lower() == "content-type"), "")
    m = _CHARSET.search(declared) or _CHARSET.search(payload[:1024].decode("ascii", "replace"))
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def record(kind: str, record_id: str, date: str, target: str | None, content_type: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    """One WARC/1.1 record, with the two line ends after its block."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_line(record_id or '')}>"), ("WARC-Date", _line(date))]
    head += [("WARC-Target-URI", _line(target))] if target is not None else []
    head += [*more, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return ("WARC/1.1" + LINE + "".join(f"{k}: {v}{LINE}" for k, v in head) + LINE).encode() + block + b"\r\n\r\n"


def derive_one(record_id: str, target: str | None, date: str, block: bytes, stated: str = "") -> list[dict]:
    """The metadata and the conversion record of one response; ``stated`` are its WARC header lines."""
    status, headers, payload = split_http(block)
    page = decoded(headers, content(headers, payload))
    text = "\n".join(b.text for b in text_blocks(page)).encode()
    title = _TITLE.search(page)
    source = [("source-block-digest", digest(block)), ("source-payload-digest", digest(payload))]
    metadata_id, conversion_id = (record_name(record_id, kind) for kind in ("metadata", "conversion"))
    source += [(f"source-{k.strip().lower()}", v) for k, _, v in (x.partition(":") for x in stated.split(LINE)) if k.strip().lower().startswith("warc-")]
    fields = [*source, ("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers)]
    fields += [("title", entities.unescape(title[1])) if title else ("title", ""), ("conversion", f"<{conversion_id}>")]
    about = "".join(f"{k}: {_line(v)}{LINE}" for k, v in fields).encode()
    refers = [("WARC-Refers-To", f"<{_line(record_id)}>")]
    out = []
    for kind, name, content_type, body in (("metadata", metadata_id, "application/warc-fields", about), ("conversion", conversion_id, "text/plain; charset=utf-8", text)):
        out.append({
            "response_id": record_id, "record_type": kind, "record_id": name, "target_uri": target, "content_type": content_type,
            "content_length": len(body), "block_digest": digest(body), "source_block_digest": source[0][1], "source_payload_digest": source[1][1],
            "record": record(kind, name, date, target, content_type, body, refers),
        })
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """The id column and a response row of each page."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in blocks(batches, html_col):
            rows = zip(*(batch.column(c).to_pylist() for c in (id_col, url_col, html_col)))
            names, sent = [], []
            for key, url, page in rows:
                payload = (page or "").encode()
                head = f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: {len(payload)}{LINE}{LINE}"
                names.append(record_name("page", "" if key is None else str(key), url or "", hashlib.sha1(payload).hexdigest()))
                sent.append(head.encode() + payload)
            cols = [batch.column(id_col), pa.array(names, pa.string()), batch.column(url_col), pa.array([date] * len(names), pa.string()), pa.array(sent, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "record_id", "target_uri", "date", "block"])

    return map_arrow(pages.select(id_col, url_col, html_col), run, f"`{id_col}` {id_type}, {RESPONSE}")


def derivatives(sources: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows per response, metadata and conversion, with the columns in ``keep`` before them.
    WARC header lines of the responses are taken from ``warc_headers`` if there is such a column."""
    keep = keep or []
    kept = [f for f in sources.schema.fields if f.name in keep]
    names = [*(f.name for f in kept), *(x.split()[0] for x in DERIVED.split(", "))]
    stated = ["warc_headers"] if "warc_headers" in sources.columns else []
    inputs = ["record_id", "target_uri", "date", "block", *stated]

    def run(batches):
        for batch in blocks(batches, "block"):
            rows = zip(*(batch.column(c).to_pylist() for c in inputs))
            found = [d for record_id, target, date, block, *more in rows for d in derive_one(record_id or record_name("", target or ""), target, date or DATE, block or b"", *(x or "" for x in more))]
            twice = pa.array([i for i in range(batch.num_rows) for _ in range(2)], pa.int64())
            cols = [*(batch.column(f.name).take(twice) for f in kept)]
            cols += [pa.array([d[n] for d in found], pa.int64() if n == "content_length" else pa.binary() if n == "record" else pa.string()) for n in names[len(kept) :]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return map_arrow(sources.select(*(f.name for f in kept), *(c for c in inputs if c not in keep)), run, head + DERIVED)


def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write the ``record`` column as WARC files. Every record ends in two line ends, which the text
    writer adds, so executors stream records straight into shared storage."""
    body = records.selectExpr("decode(substring(record, 1, length(record) - 4), 'UTF-8') as value")
    body.write.option("lineSep", LINE * 2).option("compression", compression).text(path)


def parse(data: bytes) -> list[tuple[dict, bytes]]:
    """(headers, block) of the records in a WARC file's bytes."""
    return [(head, block) for head, block, _ in _records(data)]


def _records(data: bytes) -> list[tuple[dict, bytes, str]]:
    """(headers, block, header lines in one text) of the records; a folded line is joined to its header."""
    out, at = [], 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at) if at >= 0 else -1
        if end < 0:
            return out
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split(LINE)[1:]
        head = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines if ":" in line)}
        stated = head.get("content-length", "")
        if stated.isascii() and stated.isdigit():
            stop = end + 4 + int(stated)
        else:  # missing, negative or no number: up to the next record
            stop = data.find(b"\r\n\r\nWARC/", end + 4)
            stop = stop if stop >= 0 else len(data)
        out.append((head, data[end + 4 : stop], LINE.join(lines)))
        at = stop


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (plain or gzip). A task holds one file at a time, so files
    should be cut to the usual size (about 1 GB at most)."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                found = [(h, b, x) for h, b, x in _records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data) if h.get("warc-type") == "response"]
                cols = [[h.get("warc-record-id", "").strip("<>") for h, *_ in found], [h.get("warc-target-uri") for h, *_ in found], [h.get("warc-date") for h, *_ in found]]
                arrays = [*(pa.array(c, pa.string()) for c in cols), pa.array([b for _, b, _ in found], pa.binary()), pa.array([x for *_, x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["record_id", "target_uri", "date", "block", "warc_headers"])

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), run, RESPONSE + ", warc_headers string")


def response_records(sources: DataFrame) -> DataFrame:
    """The responses themselves as WARC records (column ``record``)."""
    def run(batches):
        for batch in blocks(batches, "block"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "block")))
            made = [record("response", i, d or DATE, t, "application/http; msgtype=response", b, [("WARC-Payload-Digest", digest(split_http(b)[2]))]) for i, t, d, b in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    return map_arrow(sources.select("record_id", "target_uri", "date", "block"), run, "record binary")
