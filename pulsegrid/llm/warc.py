"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, a frame per record.

Spark's text writer puts the frames into files, so that lost tasks leave no broken archive: a row is
a frame, and what the writer puts between rows is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.arrow import map_arrow
from pulsegrid.session import cut_lineage

# --- fixed values of the formats: WARC 1.1, and Zstandard frames (RFC 8878; dictionary frame of the WARC profile) ---
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
BETWEEN = "P*M\x18\0\0\0\0"  # an empty skippable frame
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FAMILY, NO_ID = 0x6F0D2A5C3B7E4D18, 0x6F0D2A5C3B7E4D19  # upper halves of record ids

ROW = "page_id long, url string, html string, digest string, first long"
READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    number = (NO_ID << 64) if page_id is None else (FAMILY << 64) | (page_id & (2**64 - 1))
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record[10:-1]).int
    low = number & (2**64 - 1)
    return None if number >> 64 == NO_ID else low - (1 << 64) * (low >> 63)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20%\x7f]", lambda c: f"%{ord(c[0]):02X}" if c[0] != "%" else "%", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def skippable(content: bytes, magic: int = DICTIONARY_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def train(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records; None where they are too few or too small for one."""
    try:
        return zstandard.train_dictionary(size, records)
    except zstandard.ZstdError:
        return None


def _archives(date: str, per_archive: int, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int):
    """Rows of a partition to frames. An archive is exactly `per_archive` rows, since the writer begins a
    new file after so many; what ends early for its size is filled up with empty skippable frames."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        waiting: list[bytes] = []
        rows = size = 0
        packer = None

        def begin():
            nonlocal packer, rows
            learnt = train(waiting, dictionary_bytes)
            packer = zstandard.ZstdCompressor(level=level, dict_data=learnt) if learnt else zstandard.ZstdCompressor(level=level)
            rows = 1 + len(waiting)
            yield skippable(learnt.as_bytes() if learnt else b"")
            yield from map(packer.compress, waiting)
            waiting.clear()

        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "first"))):
                page_id, first = page_id.as_py(), first.as_py()
                refers_to = None if page_id == first else record_id(first)
                record = record_bytes(page_id, url.as_py(), (html.as_py() or "").encode("utf-8", "replace"), digest.as_py(), refers_to, date)
                size += len(record)
                if packer is None:
                    waiting.append(record)
                    if size >= sample_bytes or len(waiting) == per_archive - 1:
                        yield from begin()
                else:
                    yield packer.compress(record)
                    rows += 1
                if packer is not None and size >= archive_bytes:
                    yield from [skippable(b"", SKIPPABLE[0])] * (per_archive - rows)
                    rows = per_archive
                if rows == per_archive:
                    packer, rows, size = None, 0, 0
        if waiting:
            yield from begin()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for frame in frames(batches):
            held.append(frame)
            size += len(frame)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    return run


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", per_archive: int = 4096,
    archive_bytes: int = 64 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 64 << 10, level: int = 3,
) -> None:
    """Write a record for every row of `pages` (page_id, url, html); the payload is the html in UTF-8.

    Of records with equal payloads of at least `min_bytes`, those with the smallest page_id are
    responses and the others revisit it; smaller payloads are all responses. Each archive has its
    own dictionary, learnt from its first `sample_bytes` of records.

    Null html is an empty payload, a null url leaves the header out; a null page_id comes after all
    others. Rows that repeat the smallest page_id are all responses. An empty table writes no record.
    Other columns are ignored. Payloads that many pages share only gather as a count-like minimum
    before the join, whose large partitions AQE can split.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(payload).alias("sha"), F.length(payload).alias("size"))
    firsts = cut_lineage(rows.where(F.col("size") >= min_bytes).groupBy(F.col("sha").alias("_sha")).agg(F.min("page_id").alias("first")))
    shared = (F.col("sha") == F.col("_sha")) & (F.col("size") >= min_bytes)
    joined = rows.join(firsts, shared, "left").select(
        "page_id", "url", "html", F.col("sha").alias("digest"), F.when(F.col("_sha").isNull(), F.col("page_id")).otherwise(F.col("first")).alias("first")
    )
    digests = joined.withColumn("digest", base32("digest"))
    frames = map_arrow(digests, _archives(date, per_archive, archive_bytes, sample_bytes, dictionary_bytes, level), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN).option("maxRecordsPerFile", per_archive).text(path)


def base32(hex_column: str) -> F.Column:
    """Base32 of a SHA-1 in hex: four times five bytes, each cut into eight digits of five bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = []
    for i in range(0, 40, 10):
        number = F.conv(F.substring(hex_column, i + 1, 10), 16, 10).cast("long")
        digits += [F.substring(alphabet, (F.shiftright(number, shift).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*digits)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from the sizes in its block headers."""
    magic, size = struct.unpack_from("<II", data, at)
    if magic in SKIPPABLE:
        return at + 8 + size
    if magic != FRAME_MAGIC:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, length = bool(head & 1), head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else length)
    return at + 4 * (flags >> 2 & 1)


def records(content: bytes) -> Iterator[bytes]:
    """The decompressed records of an archive."""
    data, at, unpacker = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic == DICTIONARY_MAGIC and at == 0 and end > 8:
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8:end])))
        elif magic == FRAME_MAGIC:
            yield unpacker.decompress(data[at:end])
        at = end


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"broken payload in {fields['WARC-Record-ID']}")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload": payload if whole else None, "payload_bytes": length, "payload_digest": digest,
        "refers_to": page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below `path`; payloads are checked against their digests.

    Revisits have no payload of their own, but the length and digest of the full one.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for record in records(content.as_py()):
                    held.append(parse(record))
                    size += len(record)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), run, READ)
