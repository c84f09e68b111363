"""WARC archives: one gzip member per record, read back sequentially.

Archives are binary columns of DataFrames, written and read by Spark's own sinks and sources, so they may lie in any
store. `read_warc_files` reads the usual `*.warc.gz` files with the same reader.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

#: Compressed bytes after which a task closes an archive and begins the next.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes that the reader inflates at a time.
FEED_BYTES = 64 << 10

RECORD_SCHEMA = "page_id long, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest, http = base32_sha1(payload), b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    kind = "response" if refers_to is None else "revisit"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = http + payload if refers_to is None else http
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", target),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _member(headers, block)


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive binary) rows of about ARCHIVE_BYTES each, from (page_id, url, payload binary, refers_to).

    A null payload is written as an empty one; a null page_id gets a record without a number; a null url an empty target.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:warcinfo>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n")
        parts, size = [info], 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                parts.append(_record(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py()))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                    parts, size = [info], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(pack, "archive binary")


class SequentialReader:
    """Records of one archive in order: members are inflated by FEED_BYTES, blocks framed by Content-Length."""

    def __init__(self, archive: bytes):
        self._archive, self._at = memoryview(archive), 0
        self._inflate, self._out = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        """Inflates the next piece; False at the archive's end. A new member begins where the last ended."""
        if self._inflate.eof:
            self._at -= len(self._inflate.unused_data)
            self._inflate = zlib.decompressobj(31)
        if self._at >= len(self._archive):
            return False
        piece = self._archive[self._at : self._at + FEED_BYTES]
        self._at += len(piece)
        self._out += self._inflate.decompress(piece)
        return True

    def _until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (found := self._out.find(mark, seen)) < 0:
            seen = max(0, len(self._out) - len(mark) + 1)
            if not self._more():
                if self._out:
                    raise ValueError("truncated WARC header")
                return None
        head = bytes(self._out[:found])
        del self._out[: found + len(mark)]
        return head

    def _exactly(self, n: int) -> bytes:
        while len(self._out) < n:
            if not self._more():
                raise ValueError("truncated WARC block")
        block = bytes(self._out[:n])
        del self._out[:n]
        return block

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while (head := self._until(b"\r\n\r\n")) is not None:
            version, *lines = head.decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            block = self._exactly(int(fields["content-length"]))
            if self._exactly(4) != b"\r\n\r\n":
                raise ValueError("a WARC block does not end where its Content-Length says")
            yield fields, block


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per response or revisit record of (archive binary) rows, with digests verified.

    digest_ok is False where a stored block or payload digest differs from the bytes; damaged framing raises.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to", "digest_ok"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

        def frame(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for archive in batch.column("archive"):
                rows, size = [], 0
                for fields, block in SequentialReader(archive.as_py() or b""):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    ok = fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", base32_sha1(block)) and (payload is None or base32_sha1(payload) == digest)
                    length = len(payload) if payload is not None else int(fields.get("x-payload-length", -1))
                    rows.append((_number(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), payload, length, digest, _number(fields.get("warc-refers-to")), ok))
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    return archives.select("archive").mapInArrow(unpack, RECORD_SCHEMA)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of `*.warc.gz` files, one task reading one file sequentially."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")))


def deduplicated(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads the largest page_id is kept, the others refer to it.

    Payloads are equal if SHA-256 and length are. Digests are summed up before the shuffle, so a payload that a third of
    all pages share costs a row a task; pages of hot digests stay where they are and get theirs by broadcast. Null page_ids are
    responses without a number; rows with the largest page_id twice are responses both. Other columns are left out.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("payload", 256)))
    last = textkit.written(rows.groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")), "digests")
    return textkit.spread_join(rows, last, ["_digest"]).select(
        "page_id", "url", "payload", F.when(F.col("page_id") != F.col("_last"), F.col("_last")).alias("refers_to")
    )


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page as a WARC record to the shared folder, reads the archives back, returns the records."""
    return read_archives(textkit.written(write_archives(deduplicated(pages)), "warc"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_round_trip(textkit.table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")
