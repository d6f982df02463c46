"""WARC derivatives: linked metadata and plain-text conversion records for responses.

A response record becomes two records that carry its identifier in WARC-Refers-To: a "metadata" record
(application/warc-fields) with what the response's headers say and the digests of its payload and text, and a
"conversion" record (text/plain) with all the text that the page shows. Both keep the target URI and date of their
source, and the source's HTTP headers are kept word by word: in the metadata record as fields "source-header: name:
value", one for each header, in order. Identifiers are UUIDs (version 5) of the source's identifier and the kind of
derivative, so a repeated run, or a task that is run again, gives the same records. Digests are SHA-1 in base 32 over
the exact bytes of a record's block, as is the custom of web archives.

Archives are read with Spark's text source, so that any store which Spark reads will do. It cuts files where a version line
(of WARC/1.0, 1.1 and other versions 1) follows two line ends; as blocks may hold that, too, Content-Length decides: a
piece that is shorter than it says goes on in the next one. A gzip file (one member for each record, or one in all) is
streamed by one task. A plain file is split over many tasks; only if a record is not complete at the end of one's range
is that file put in order and read by a single task. A record that does not agree with its Content-Length even so is
passed on, marked as not intact, and has no derivatives: nothing is left out unseen. Records are written with Spark's text
sink; a task that is run again writes its file again. Else nothing is shuffled.

Bodies that are chunked, or compressed as gzip, deflate or zstd, are decoded before their text is extracted; another
encoding, or a body that does not decode, gives an empty text and a field "source-undecoded" in the metadata record.

Nulls and odd rows: a null URL gives records without a target URI; a null or empty page has an empty payload and an empty
text. Repeated rows give repeated records with the same identifiers. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .dom import plain_text

VERSION = "WARC/1.0"
#: Date of records made from rows that have none.
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, source_digest string, block string"
_FIELDS = [f.split(" ")[0] for f in RECORD.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A version-5 UUID of the parts, as a WARC identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def one_line(value: str | None) -> str | None:
    """value as it may stand in a header: without line ends."""
    return None if value is None else " ".join(value.split("\r\n")).replace("\r", " ").replace("\n", " ")


def response_of(key: object, url: str | None, html: str | None, date: str = DATE) -> dict:
    """The response record of a fetched page."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload
    return {"record_id": record_id("response", str(key), url or "", date), "target_uri": one_line(url), "warc_date": date, "block_digest": digest(block), "payload_digest": digest(payload), "block": block}


def split_http(block: bytes) -> tuple[list[str], bytes]:
    """Status line and headers of an HTTP message, and its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return head.decode("latin-1").split("\r\n"), payload


def charset(headers: list[str]) -> str:
    for h in headers[1:]:
        name, _, value = h.partition(":")
        if name.strip().lower() == "content-type" and "charset=" in value.lower():
            return value.lower().partition("charset=")[2].split(";")[0].strip(" \"'")
    return "utf-8"


def decoded(payload: bytes, headers: list[str]) -> str:
    try:
        return payload.decode(charset(headers), "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def header(headers: list[str], name: str) -> str:
    """Value of the last header of that name, in lower case; empty if there is none."""
    found = [v for n, _, v in (h.partition(":") for h in headers[1:]) if n.strip().lower() == name]
    return found[-1].strip().lower() if found else ""


def unchunked(data: bytes) -> bytes:
    """A body from its chunks."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        if len(data) < end + 2 + size:
            raise ValueError("chunk cut short")
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def body(headers: list[str], payload: bytes) -> bytes | None:
    """The payload without transfer and content encodings; None if it can't be decoded."""
    try:
        if "chunked" in header(headers, "transfer-encoding"):
            payload = unchunked(payload)
        for name in reversed(header(headers, "content-encoding").split(",")):
            name = name.strip()
            if name in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif name == "deflate":
                try:
                    payload = zlib.decompress(payload)
                except zlib.error:
                    payload = zlib.decompress(payload, -zlib.MAX_WBITS)
            elif name == "zstd":
                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
            elif name not in ("", "identity"):
                return None
    except (ValueError, EOFError, OSError, zlib.error, zstandard.ZstdError):
        return None
    return payload


def derive_one(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    headers, payload = split_http(response["block"])
    content = body(headers, payload)
    text = "" if content is None else plain_text(decoded(content, headers))
    source = response.get("payload_digest") or digest(payload)
    text_block = text.encode()
    ids = {kind: record_id(kind, response["record_id"]) for kind in ("metadata", "conversion")}
    fields = [("source-status", headers[0])] + [("source-header", h) for h in headers[1:] if h]
    if content is None:
        fields.append(("source-undecoded", header(headers, "content-encoding") or header(headers, "transfer-encoding")))
    fields += [("source-block-digest", response.get("block_digest") or digest(response["block"])), ("source-payload-digest", source), ("source-payload-length", str(len(payload))), ("conversion-id", ids["conversion"]), ("conversion-digest", digest(text_block)), ("conversion-characters", str(len(text)))]
    meta = "".join(f"{name}: {value}\r\n" for name, value in fields)
    common = {"refers_to": response["record_id"], "target_uri": response["target_uri"], "warc_date": response["warc_date"], "source_digest": source}
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode()
        out.append({"record_type": kind, "record_id": ids[kind], **common, "content_type": content_type, "content_length": len(data), "block_digest": digest(data), "payload_digest": digest(data), "block": block})
    return out


def _batch(rows: list[dict], keys: list, key_type: pa.DataType) -> pa.RecordBatch:
    arrays = [pa.array(keys, key_type)] + [pa.array([r[f] for r in rows], pa.int64() if f == "content_length" else pa.string()) for f in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=["id", *_FIELDS])


def derive_pages(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", date: str = DATE) -> DataFrame:
    """Two rows for each page: its response's metadata and conversion record. The response itself is not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                rows, keys = [], []
                for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows += derive_one(response_of(k, u, h, date))
                    keys += [k, k]
                yield _batch(rows, keys, batch.schema.field(0).type)

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    return map_arrow(rows, run, f"id {kind}, {RECORD}").withColumnRenamed("id", key)


def responses(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", date: str = DATE) -> DataFrame:
    """One response record for each page, as rows of read_archive()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [response_of(k, u, h, date) for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            rows = [r | {"record_type": "response", "refers_to": None, "content_type": "application/http; msgtype=response", "content_length": len(r["block"]), "source_digest": None, "intact": True} for r in found]
            yield _archive_batch(rows)

    return map_arrow(pages.select(F.col(f"`{key}`"), F.col(f"`{url}`").cast("string"), F.col(f"`{html}`").cast("string")), run, ARCHIVE)


ARCHIVE = RECORD.replace("block string", "block binary") + ", intact boolean"


def _archive_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"content_length": pa.int64(), "block": pa.binary(), "intact": pa.bool_()}
    names = [*_FIELDS, "intact"]
    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in names], names=names)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the intact response records among rows of read_archive()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # one at a time: a block may be large
                made = derive_one(row)
                yield _batch(made, [row["record_id"]] * 2, pa.string())

    wanted = records.where("record_type = 'response' AND intact").select("record_id", "target_uri", "warc_date", "block_digest", "payload_digest", "block")
    return map_arrow(wanted, run, f"id string, {RECORD}").drop("id")


_HEADERS = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "warc_date", "content-type": "content_type", "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest", "warc-source-digest": "source_digest"}


def parse_record(data: bytes) -> dict | None:
    """A record from its bytes, with or without the version line and the two line ends behind it; None if there is none."""
    head, found, block = data.partition(b"\r\n\r\n")
    lines = [x for x in head.decode("utf-8", "replace").split("\r\n") if x and not x.startswith("WARC/")]
    if not lines:
        return None
    row: dict = dict.fromkeys([*_FIELDS, "intact"])
    for line in lines:
        name, _, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name in _HEADERS:
            row[_HEADERS[name]] = value
        elif name == "content-length" and value.isdecimal():
            row["content_length"] = int(value)
    size = row["content_length"]
    row["intact"] = bool(found) and size is not None and len(block) >= size and not block[size:].strip(b"\r\n")
    row["block"] = block[:size] if row["intact"] else block
    return row


#: Between two records, and what is left of the next one's version line.
_BETWEEN = _END + "WARC/1."


class Joiner:
    """Records from the pieces of files, in order: pieces are laid together until Content-Length is reached."""

    def __init__(self) -> None:
        self.file: str | None = None
        self.parts: list[bytes] = []
        self.size, self.wanted = 0, 0

    def add(self, file: str, piece: bytes) -> Iterator[tuple[dict, str, bool]]:
        """Rows that are complete now, their file, and whether their end was seen."""
        if file != self.file:
            yield from self.end()
            self.file = file
        if self.parts:
            piece = _BETWEEN.encode() + piece
        else:
            head, found, block = piece.partition(b"\r\n\r\n")
            lengths = [v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if n.strip().lower() == b"content-length"]
            self.wanted = len(head) + 4 + int(lengths[-1]) if found and lengths and lengths[-1].isdigit() else 0
        self.parts.append(piece)
        self.size += len(piece)
        if self.size >= self.wanted:
            yield from self.end()

    def end(self) -> Iterator[tuple[dict, str, bool]]:
        """What there is of the record that is not complete yet."""
        if self.parts and (row := parse_record(b"".join(self.parts))) is not None:
            yield row, self.file, self.size >= self.wanted
        self.parts, self.size = [], 0


def read_archive(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of WARC files, plain or gzip. A record that its file does not hold whole is there, not intact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner()

        def out(found: Iterator[tuple[dict, str, bool]]) -> Iterator[pa.RecordBatch]:
            for row, file, ended in found:
                batch = _archive_batch([row])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([file]), pa.array([ended])], names=[*batch.schema.names, "file", "ended"])

        for batch in batches:
            for data, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                yield from out(joiner.add(file, data.as_py()))
        yield from out(joiner.end())

    def pieces(path: str | list[str]) -> DataFrame:
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
        return spark.read.option("lineSep", _BETWEEN).text(path).select(F.col("value").cast("binary").alias("value"), *place)

    schema = f"{ARCHIVE}, file string, ended boolean"
    records = map_arrow(pieces(path).select("value", "file"), run, schema)
    broken = cut(records.where("NOT ended").select("file").distinct())
    if broken.isEmpty():
        return records.drop("file", "ended")
    whole = pieces(path).join(broken, "file", "left_semi").withColumn("n", F.monotonically_increasing_id())
    whole = whole.repartition("file").sortWithinPartitions("file", "start", "n").select("value", "file")
    return records.join(broken, "file", "left_anti").unionByName(map_arrow(whole, run, schema)).drop("file", "ended")


def serialised(block: str = "block") -> Column:
    """A record as the bytes of an archive, from the columns of RECORD or ARCHIVE."""
    header = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    names = {v: k for k, v in _HEADERS.items()}
    proper = {"warc-type": "WARC-Type", "warc-record-id": "WARC-Record-ID", "warc-refers-to": "WARC-Refers-To", "warc-target-uri": "WARC-Target-URI", "warc-date": "WARC-Date", "content-type": "Content-Type", "warc-block-digest": "WARC-Block-Digest", "warc-payload-digest": "WARC-Payload-Digest", "warc-source-digest": "WARC-Source-Digest"}
    heads = [header(proper[names[c]], c) for c in ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "source_digest")]
    return F.concat(F.lit(VERSION + "\r\n"), *heads, header("Content-Length", "content_length"), F.lit("\r\n"), F.col(block).cast("string"))


def write_archive(records: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """Writes records as WARC files, one for each partition."""
    writer = records.select(serialised().alias("value")).write.option("lineSep", _END)
    (writer.option("compression", compression) if compression else writer).text(path)
