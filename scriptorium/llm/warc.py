"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame per record.

``write_archives`` packs pages into archives of bounded size, one binary value each, so that any Spark
sink can hold them; ``read_archives`` takes (path, content) rows, as Spark's binaryFile source gives
them, and yields a row per record.

Defined results: a null html is the empty payload; of records with equal payloads of at least 1000
bytes that with the largest page_id is the response and the others are revisits of it (rows that share
this page_id are all responses, a null page_id is never the largest unless all are null, and then all
are responses); a null url is written as an empty one; repeated rows give repeated records; an empty
table gives no archive; a very long html is a record like any other, in an archive of its own if need be. A frame that can't be decoded or a record whose version, headers or lengths
don't hold gives a row with ``error`` set, and reading goes on at the next frame. Columns that aren't
named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import slices, tidy

ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLES, LEVEL, SALTS = 16 << 20, 32 << 10, 256, 3, 32
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (HTTP head only) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of records: the dictionary frame, then a frame for each."""
    samples = records[:: max(1, len(records) // SAMPLES)]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:  # too few or too short samples
        trained = zstandard.ZstdCompressionDict(b"".join(x[:1024] for x in samples)[:DICTIONARY_BYTES])
    body = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
    codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body + b"".join([codec.compress(x) for x in records])


def _write(limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{number:05d}.warc.zst"]), pa.array([archive_bytes(held)], pa.binary())], names=["path", "content"])

        for part in slices(batches, 2):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                x = record_bytes(*row)
                if held and size + len(x) > limit:
                    yield archive()
                    held, size, number = [], 0, number + 1
                held.append(x)
                size += len(x)
        if held:
            yield archive()

    return write


def write_archives(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes_limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content) rows, an archive each, of all pages; an archive ends before it holds more than the limit."""
    pages = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= LEAST_REVISIT
    groups = pages.filter(long).groupBy("digest").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    # a popular payload has one digest: its rows are dealt over SALTS places, and each of the few groups goes to all of them
    salt = F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")
    places = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = pages.filter(long).withColumn("salt", salt).join(places, ["digest", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key")), F.col("first"))
    columns = ("key", "url", "payload", "digest", "refers_to")
    # short pages need no partner and stay where they are
    records = joined.withColumn("refers_to", refers).select(*columns).unionByName(pages.filter(~long).withColumn("refers_to", F.lit(None).cast(df.schema[key].dataType)).select(*columns))
    return records.mapInArrow(tidy(_write(archive_bytes_limit)), "path string, content binary")


# --- reading -----------------------------------------------------------------------------------


def frame_end(data: bytes, at: int) -> int:
    """The byte after the Zstandard frame that begins at a place, from its block headers alone."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    else:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise ValueError(f"the frame at byte {at} is cut short")
            head = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            if kind == 3:
                raise ValueError(f"a reserved block in the frame at byte {at}")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ValueError(f"the frame at byte {at} is cut short")
    return end


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:40]!r}")
        out[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(raw: bytes) -> dict:
    """The fields of a record, after its version, lengths and digests were found right."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")) or not found:
        raise ValueError("no WARC version line or no end of headers")
    fields = _headers(head)
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a content length of {length} for a block of {len(rest) - 4} bytes")
    block = rest[:length]
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("the block digest differs")
    kind = fields["warc-type"]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_length = int(_headers(http).get("content-length", len(payload)))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != http_length:
            raise ValueError(f"a payload length of {http_length} for {len(payload)} bytes")
        own = hashlib.sha1(payload).hexdigest()
        if digest and digest != own:
            raise ValueError("the payload digest differs")
        digest = own
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields.get("warc-page-id")), "record_type": kind, "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": http_length, "payload_digest": digest, "refers_to": number(fields.get("warc-refers-to-page-id"))}


FIELDS = {"page_id": pa.int64(), "record_type": pa.string(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}


def records(content: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, frame bytes, fields, error) of each record of an archive."""
    at, codec = 0, zstandard.ZstdDecompressor()
    while at < len(content):
        try:
            end = frame_end(content, at)
        except (ValueError, IndexError) as e:
            yield at, len(content) - at, None, str(e)
            return
        magic = int.from_bytes(content[at : at + 4], "little")
        try:
            if magic == DICTIONARY_MAGIC and not at:
                body = content[8:end]
                body = zstandard.ZstdDecompressor().decompress(body) if body.startswith(FRAME_MAGIC.to_bytes(4, "little")) else body
                codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            elif magic == FRAME_MAGIC:
                yield at, end - at, parse_record(codec.decompressobj().decompress(content[at:end])), None
        except (ValueError, KeyError, zstandard.ZstdError) as e:
            yield at, end - at, None, str(e)
        at = end


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, content = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                found = records(content)
                while chunk := [x for _, x in zip(range(256), found)]:
                    columns = [pa.array([path] * len(chunk)), pa.array([x[0] for x in chunk], pa.int64()), pa.array([x[1] for x in chunk], pa.int64())]
                    columns += [pa.array([None if x[2] is None or name == "payload" and not with_payload else x[2][name] for x in chunk], t) for name, t in FIELDS.items()]
                    columns.append(pa.array([x[3] for x in chunk], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "frame_offset", "frame_bytes", *FIELDS, "error"])

    return read


def read_archives(df: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of (path, content) archives; payloads only if asked for."""
    schema = "path string, frame_offset long, frame_bytes long, page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, error string"
    return df.select("path", "content").mapInArrow(tidy(_read(with_payload)), schema)
