"""WARC archives compressed with Zstandard: a leading skippable frame holds the dictionary (as it is, or itself a frame), then each
record is a frame of its own.

read() decodes a frame at a time with the archive's dictionary, parses the record's header and checks it: version, the mandatory fields, a
Content-Length of digits that is the block's length, the two empty lines that end a record, and its block digest. write() makes such archives of
pages.

Defined cases: a broken record is a row with valid false and the error, fields that could be read set; reading goes on at the next frame. An
archive that isn't Zstandard, or null, gives one row with the error; an empty one no rows. Without a
dictionary frame, or with an empty one, frames are decoded without. Pages with a null url or html are written as an empty one, a null page_id as
no id, and repeated pages repeatedly; other columns are ignored; an empty table gives an empty result. Repeated header fields: the first counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import arrow_map, picked, table
from graphloom.session import ship

#: The frame that holds a dictionary, and those of data.
DICTIONARY_MAGIC, FRAME_MAGIC, RAW_DICTIONARY = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
#: Bytes of a dictionary that is trained, of pages that it's trained on, and of pages in an archive.
DICTIONARY_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES = 64 << 10, 4 << 20, 32 << 20
LEVEL = 3
#: What a binary value of a row can hold: a longer block's payload is null, but its length and digest are checked like any other's.
MOST_PAYLOAD = (1 << 31) - (1 << 20)
DATE = "2024-01-01T00:00:00Z"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
SCHEMA = "archive string, frame_at bigint, warc_type string, record_id string, target_uri string, warc_date string, content_type string, content_length bigint, payload binary, valid boolean, error string"
_NAME = re.compile(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+")


class Broken(ValueError):
    pass


def record(uri: str, body: bytes, name: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    fields = [("WARC-Type", "resource"), ("WARC-Record-ID", name), ("WARC-Date", DATE), *([("WARC-Target-URI", uri)] if uri else []), ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + body + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """An archive of records, with a dictionary trained on the first of them if there are enough to train one."""
    sample, n = [], 0
    for r in records:
        if n >= SAMPLE_BYTES:
            break
        sample.append(r[: SAMPLE_BYTES - n])
        n += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 16 else b""
    except zstandard.ZstdError:
        trained = b""
    out = []
    if trained:
        body = zstandard.ZstdCompressor(level=19).compress(trained)
        out.append(DICTIONARY_MAGIC + len(body).to_bytes(4, "little") + body)
    made = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}))
    return b"".join(out + [made.compress(r) for r in records])


def _dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive, and where its records begin."""
    if data[:4] != DICTIONARY_MAGIC:
        return None, 0
    end = 8 + int.from_bytes(data[4:8], "little")
    if len(data) < end or len(data) < 8:
        raise Broken("the dictionary's frame is cut off")
    body = data[8:end]
    if body[:4] == FRAME_MAGIC:
        try:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError as e:
            raise Broken("the dictionary can't be decoded") from e
    if not body:
        return None, end
    if body[:4] != RAW_DICTIONARY:
        raise Broken("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), end


def parse(data: bytes) -> tuple[dict, str | None]:
    """Fields of a record, and what is wrong with it."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    out: dict = {}
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return out, "no WARC version"
    if not blank:
        return out, "the header doesn't end"
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not _NAME.fullmatch(name):
            return out, "a header line isn't a field"
        last = name.lower()
        fields.setdefault(last, value.strip())
    out = {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"), "content_type": fields.get("content-type")}
    if missing := [m for m in MANDATORY if not fields.get(m)]:
        return out, f"no {missing[0]}"
    if out["warc_type"] not in TYPES:
        return out, "unknown warc-type"
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", out["warc_date"]):
        return out, "warc-date is no UTC time"
    if not re.fullmatch(r"[0-9]+", fields["content-length"]):
        return out, "content-length is no number"
    length = out["content_length"] = int(fields["content-length"])
    if length >= 1 << 63:
        del out["content_length"]
        return out, "content-length is no number"
    if len(rest) != length + 4:
        return out, f"content-length is {length}, the block has {max(len(rest) - 4, 0)} bytes"
    if rest[length:] != b"\r\n\r\n":
        return out, "the record doesn't end with two empty lines"
    block = rest[:length]
    digest = fields.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and digest[5:].upper() != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return out, "the block's digest differs"
    out["payload"] = block
    return out, None


def records(data: bytes) -> Iterator[dict]:
    """A row for each frame of an archive."""
    view = memoryview(data)
    try:
        words, at = _dictionary(data)
    except Broken as e:
        yield {"frame_at": 0, "valid": False, "error": str(e)}
        return
    decoder = zstandard.ZstdDecompressor(**({"dict_data": words} if words else {}))
    while at < len(data):
        row = {"frame_at": at}
        if data[at + 1 : at + 4] == b"\x2a\x4d\x18" and data[at] & 0xF0 == 0x50 and at + 8 <= len(data):  # another skippable frame
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        try:
            one = decoder.decompressobj()
            parts, end = [], at
            while end < len(data) and not one.eof:  # the frame's end is known only when it's decoded
                parts.append(one.decompress(view[end : end + (1 << 16)]))
                end = min(end + (1 << 16), len(data))
            if not one.eof:
                raise Broken("the frame is cut off")
            end -= len(one.unused_data)
            fields, wrong = parse(b"".join(parts))
            yield row | fields | {"valid": wrong is None, "error": wrong}
        except (zstandard.ZstdError, Broken) as e:
            yield row | {"valid": False, "error": str(e) if isinstance(e, Broken) else "the frame can't be decoded"}
            end = data.find(FRAME_MAGIC, at + 1)
            end = len(data) if end < 0 else end
        at = end


def files(spark: SparkSession, path: str) -> DataFrame:
    """The archives below a path, a row of path and content each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", True).load(path).select("path", "content")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives: path and content, as the binaryFile source gives them."""

    def make():
        kinds = {"frame_at": pa.int64(), "content_length": pa.int64(), "valid": pa.bool_(), "payload": pa.binary()}
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def rows_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([None if n == "payload" and len(r.get(n) or b"") > MOST_PAYLOAD else r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        return rows_of

    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, size = [], 0
                found = records(content.as_py()) if content.is_valid else iter([{"valid": False, "error": "no archive"}])
                for r in found:
                    rows.append({"archive": path.as_py()} | r)
                    size += len(r.get("payload") or b"")
                    if size > 8 << 20:
                        yield rows_of(rows)
                        rows, size = [], 0
                if rows:
                    yield rows_of(rows)

    return archives.selectExpr("cast(path as string) path", "cast(content as binary) content").mapInArrow(run, SCHEMA)


def write(pages: DataFrame) -> DataFrame:
    """Archives of pages as rows of path and content."""
    pages = picked(pages, page_id="bigint", url="string", html="string")
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made(records: list[bytes]) -> pa.RecordBatch:
            data = archive(records)
            return pa.record_batch({"path": pa.array([hashlib.sha1(data).hexdigest() + ".warc.zst"]), "content": pa.array([data], pa.binary())})

        for b in batches:
            for page, url, html in zip(*(b.column(c) for c in ("page_id", "url", "html")), strict=True):
                body = (html.as_py() or "").encode()
                uri = re.sub(r"[\r\n]+\s*", " ", url.as_py() or "")
                held.append(record(uri, body, f"<urn:page:{page.as_py() if page.is_valid else ''}>"))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return pages.mapInArrow(run, "path string, content binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read again: what each record holds."""
    got = read(write(table(spark, sf_dir, "pages")))
    return got.select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(.*)>$', 1) as bigint)").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.decode("payload", "UTF-8").alias("html"),
        "content_length",
        "warc_type",
        "valid",
    )


ORACLE = """select page_id, url, html, octet_length(encode(html))::bigint as content_length, 'resource' as warc_type, true as valid from pages"""
