"""WARC archives as seekable Zstandard bundles.

A bundle is one binary value: independent Zstandard frames of several WARC records each, and a
skippable frame with the seek table at its end (the public seekable format). Bundles and the index
from record to (bundle, frame, offset in the frame) are tables that Spark writes and commits, so
they work in any store Spark can write to and a lost task leaves nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
LEVEL = 3
MIN_REVISIT_BYTES = 0
_SKIPPABLE, _FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_HTTP = "application/http; msgtype=response"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id, url: str | None, payload: bytes, refers_to=None, refers_to_url: str | None = None) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit has the HTTP headers only."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"X-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}", f"Content-Type: {_HTTP}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _line(url))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_to_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + _line(refers_to_url))
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The warcinfo record of a file of that name."""
    fields = b"software: groundshift\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'bundle:{name}')}>", f"WARC-Date: {_DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + fields + b"\r\n\r\n"


def http_payload(block: bytes) -> bytes:
    """What follows the headers of an HTTP response."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and body of the record at that offset, and where the next one starts."""
    if data[at : at + 10] != b"WARC/1.1\r\n":
        raise ValueError(f"no record at {at}")
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at + 10 : end].decode("utf-8", "surrogatepass").split("\r\n"))
    body = end + 4
    after = body + int(head["Content-Length"])
    if data[after : after + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} does not end where its length says")
    return head, data[body:after], after + 4


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames (compressed bytes, plain size) with the seek table as a skippable last frame."""
    table = b"".join(struct.pack("<II", len(data), plain) for data, plain in frames)
    table += struct.pack("<IBI", len(frames), 0, _FOOTER_MAGIC)
    return b"".join(data for data, _ in frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer alone."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _FOOTER_MAGIC:
        raise ValueError("the bundle has no seek table")
    width = 12 if descriptor & 0x80 else 8
    start, out, at = len(bundle) - 9 - count * width, [], 0
    for i in range(count):
        size, plain = struct.unpack_from("<II", bundle, start + i * width)
        out.append((at, size, plain))
        at += size
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, size, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=max(plain, 1))


def with_info(bundle: bytes, name: str) -> bytes:
    """The bundle with a first frame that holds the warcinfo record of a file of that name."""
    record = info_record(name)
    first = (zstandard.ZstdCompressor(level=LEVEL).compress(record), len(record))
    return seal([first] + [(bundle[at : at + size], plain) for at, size, plain in seek_table(bundle)])


_BUNDLES = "bundle_id string, content binary, entries array<struct<page_id: long, record_id: string, frame: int, offset: int>>"
_ENTRY = pa.list_(pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())]))


def _bundler(frame_bytes: int, bundle_bytes: int):
    schema = pa.schema([("bundle_id", pa.string()), ("content", pa.binary()), ("entries", _ENTRY)])

    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        frames, entries, plain, held = [], [], bytearray(), 0

        def close_frame():
            nonlocal plain, held
            if plain:
                data = packer.compress(bytes(plain))
                frames.append((data, len(plain)))
                held += len(plain)
                plain = bytearray()

        def close_bundle():
            nonlocal frames, entries, held
            close_frame()
            name = hashlib.sha1("".join(e["record_id"] for e in entries).encode()).hexdigest()
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seal(frames)], pa.binary()), pa.array([entries], _ENTRY)], schema=schema)
            frames, entries, held = [], [], 0
            return out

        for batch in batches:
            for row in batch.to_pylist():
                record = build_record(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["refers_to"], row["refers_to_url"])
                entries.append({"page_id": row["page_id"], "record_id": record_id(row["page_id"]), "frame": len(frames), "offset": len(plain)})
                plain += record
                if len(plain) >= frame_bytes:
                    close_frame()
                if held >= bundle_bytes:
                    yield close_bundle()
        if entries:
            yield close_bundle()

    return run


def write_archives(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles with their index: bundle_id, content, entries (page_id, record_id, frame, offset).

    ``pages`` has page_id, url and html; other columns are ignored. A null html is an empty
    payload. Among equal payloads of at least ``min_revisit_bytes`` bytes the largest page_id is
    the response and the others revisit it; rows of one page_id are each a response if it is the
    largest. A revisit names the response's url, the greatest if rows of its page_id differ in it. A page without page_id is a response of its own. The result is a table in the shared
    folder; an empty input gives an empty one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    chosen = rows.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.min("page_id").alias("low"))
    chosen = chosen.where("low < best.page_id").select("digest", F.col("best.page_id").alias("top"), F.col("best.url").alias("top_url"))
    rows = rows.join(chosen.hint("merge"), "digest", "left")
    revisits = (F.col("page_id") < F.col("top")) & (F.col("n") >= min_revisit_bytes)
    rows = rows.select("page_id", "url", "html", F.when(revisits, F.col("top")).alias("refers_to"), F.when(revisits, F.col("top_url")).alias("refers_to_url"))
    return materialize(rows.mapInArrow(_bundler(frame_bytes, bundle_bytes), _BUNDLES), "warc-bundles")


def record_index(archives: DataFrame) -> DataFrame:
    """record_id, page_id, bundle_id, frame, offset of every record."""
    return archives.select("bundle_id", F.explode("entries").alias("e")).select("e.record_id", "e.page_id", "bundle_id", "e.frame", "e.offset")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record read back through the seek tables and the index: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    A response's payload is hashed again and must match its header.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out, frame, data = [], -1, b""
                for e in row["entries"]:
                    if e["frame"] != frame:
                        frame, data = e["frame"], read_frame(row["content"], e["frame"])
                    head, block, _ = parse_record(data, e["offset"])
                    body = http_payload(block)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (payload_digest(body) != digest or len(body) != int(head["X-Payload-Length"])):
                        raise ValueError(f"payload of {e['record_id']} is damaged")
                    refers = head.get("X-Refers-To-Page-ID")
                    out.append({"page_id": int(head["X-Page-ID"]) if head["X-Page-ID"] else None, "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(refers) if refers else None})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return archives.mapInArrow(run, _READ)


def read_payloads(archives: DataFrame, page_ids: list[int] | None = None, record_ids: list[str] | None = None) -> DataFrame:
    """page_id and payload of some pages or records, each found by its index entry; a revisit has an empty one.

    The lists go into the plan. A bundle goes to Python once if it holds any, and only the frames asked for are unpacked.
    """
    asked = lambda e: e["page_id"].isin(page_ids or []) | e["record_id"].isin(record_ids or [])
    wanted = archives.select("content", F.filter("entries", asked).alias("entries")).where(F.size("entries") > 0)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bodies = [http_payload(parse_record(read_frame(row["content"], e["frame"]), e["offset"])[1]) for e in row["entries"]]
                yield pa.RecordBatch.from_arrays([pa.array([e["page_id"] for e in row["entries"]], pa.int64()), pa.array(bodies, pa.binary())], names=["page_id", "payload"])

    return wanted.mapInArrow(run, "page_id long, payload binary")


def export_files(archives: DataFrame, folder: str, warcinfo: bool = False) -> DataFrame:
    """Write each bundle as ``<bundle_id>.warc.zst`` to a folder mounted on every executor; paths.

    With ``warcinfo`` a frame with the file's warcinfo record comes first; the seek table counts it, so that the
    index's frames are one further on.
    """

    def run(batches):
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                path = Path(folder, f"{row['bundle_id']}.warc.zst")
                part = path.with_suffix(f".{uuid.uuid4().hex}.part")
                part.write_bytes(with_info(row["content"], path.name) if warcinfo else row["content"])
                part.replace(path)
                names.append(str(path))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    return archives.select("bundle_id", "content").mapInArrow(run, "path string")
