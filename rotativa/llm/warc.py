"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is its frames followed by a skippable frame
with the seek table (compressed and uncompressed size of each frame). ``index`` maps a record to its
bundle, its frame and its place inside the uncompressed frame, so that one record is read by
decompressing one frame. Bundles are rows of a table, written with Spark's commit protocol to any
store that Spark can write to; the bytes of a row are a complete ``.warc.zst`` file.

Null ids and null pages are written like others, with an empty payload for a null. Of equal payloads
of at least ``min_revisit`` bytes the smallest id is a response and the others are revisits; a null
id comes after all others, and of rows with the same id and payload one, and all its repeats, are
responses. An empty table gives no bundle. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.llm.common import hot_keys, with_parts

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 16 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2025-01-01T00:00:00Z"
BUNDLES = (
    "bundle string, content binary, frames int, "
    "index array<struct<record: string, frame: int, offset: bigint, length: bigint>>"
)
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def page_of(name: str) -> int | None:
    number = name.rpartition(":")[2]
    return None if number == "null" else int(number)


def write_record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_name(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        head += [
            f"WARC-Refers-To: <{record_name(refers_to)}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the end of the record that starts at ``at``."""
    blank = data.index(b"\r\n\r\n", at)
    lines = data[at:blank].decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = blank + 4
    end = start + int(headers["Content-Length"])
    return headers, data[start:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    tail = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(tail)) + entries + tail


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    sizes = struct.iter_unpack("<II", bundle[-9 - 8 * count : -9])
    frames, at = [], 0
    for packed, plain in sizes:
        frames.append((at, packed, plain))
        at += packed
    return frames


def read_frame(bundle: bytes, frame: int) -> bytes:
    import zstandard

    at, packed, plain = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


class BundleWriter:
    """Collects records into frames and frames into a bundle."""

    def __init__(self):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.frames, self.sizes, self.index, self.plain, self.packed = [], [], [], bytearray(), 0

    def add(self, name: str, record: bytes) -> None:
        if self.plain and len(self.plain) + len(record) > FRAME_BYTES:
            self.end_frame()
        self.index.append({"record": name, "frame": len(self.frames), "offset": len(self.plain), "length": len(record)})
        self.plain += record

    def end_frame(self) -> None:
        self.frames.append(self.compressor.compress(bytes(self.plain)))
        self.sizes.append((len(self.frames[-1]), len(self.plain)))
        self.packed += len(self.frames[-1])
        self.plain = bytearray()

    def finish(self) -> dict:
        if self.plain:
            self.end_frame()
        content = b"".join(self.frames) + seek_table(self.sizes)
        # Named by its content, so that a repeated task writes the same bundle.
        row = {"bundle": hashlib.sha1(content).hexdigest(), "content": content, "frames": len(self.sizes), "index": self.index}
        self.clear()
        return row


def with_revisits(pages: DataFrame, html: str = "html", min_revisit: int = 0) -> DataFrame:
    """(page_id, url, payload, sha, refers_to, revisit); payloads move only once, by digest.

    A payload with a large part of the pages is split; only its smallest id is copied to the parts.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    made = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # A digest of 256 bits stands for the payload while equal ones are sought.
    keyed = made.withColumn("_same", F.sha2("payload", 256))
    narrow = keyed.filter(F.length("payload") >= min_revisit).select("_same", "page_id")
    firsts = narrow.groupBy("_same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hot = hot_keys(narrow, ["_same"])
    parted = with_parts(keyed, ["_same"], hot).withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.col("_parts")))
    copied = with_parts(firsts, ["_same"], hot).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    copied = copied.withColumn("_part", F.col("_part").cast("bigint")).drop("_parts")
    joined = parted.drop("_parts").join(copied, ["_same", "_part"], "left")
    # With an all-null group there is no smallest id, and each of its rows is a response.
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(pages: DataFrame, html: str = "html", min_revisit: int = 0) -> DataFrame:
    """Bundles of about ``BUNDLE_BYTES`` compressed bytes, with their index. Lazy; write the table to keep it."""

    def write(batches: Iterator[pa.RecordBatch]):
        writer = BundleWriter()
        kinds = pa.schema([
            ("bundle", pa.string()), ("content", pa.binary()), ("frames", pa.int32()),
            ("index", pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
        ])
        for batch in batches:
            for row in zip(*[batch.column(n) for n in ("page_id", "url", "payload", "refers_to", "revisit")], strict=True):
                page_id, url, payload, refers_to, revisit = (c.as_py() for c in row)
                writer.add(record_name(page_id), write_record(page_id, url, payload, digest(payload), refers_to, revisit))
                if writer.packed >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pylist([writer.finish()], kinds)
        if writer.index:
            yield pa.RecordBatch.from_pylist([writer.finish()], kinds)

    return with_revisits(pages, html, min_revisit).mapInArrow(write, BUNDLES)


def record_index(bundles: DataFrame) -> DataFrame:
    """One row per record: record, bundle, frame, offset, length."""
    return bundles.select("bundle", F.inline("index")).select("record", "bundle", "frame", "offset", "length")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, read frame by frame through the seek table."""

    def read(batches: Iterator[pa.RecordBatch]):
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for content in batch.column("content"):
                bundle = content.as_py()
                for at, packed, plain in read_seek_table(bundle):
                    data = decompressor.decompress(bundle[at : at + packed], max_output_size=plain)
                    rows, place = [], 0
                    while place < len(data):
                        headers, block, place = read_record(data, place)
                        page, kind = page_of(headers["WARC-Record-ID"][1:-1]), headers["WARC-Type"]
                        if kind == "response":
                            body = block[block.index(b"\r\n\r\n") + 4 :]
                            rows.append((page, len(body), digest(body), kind, None))
                        else:
                            first = page_of(headers["WARC-Refers-To"][1:-1])
                            sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                            rows.append((page, int(headers["X-Payload-Length"]), sha, kind, first))
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return bundles.select("content").mapInArrow(read, RECORDS)


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle to ``folder`` as ``<bundle>.warc.zst``; the folder must be mounted on every executor.

    Each file appears under its name only when complete, so a repeated task does no harm.
    """

    def export(batches: Iterator[pa.RecordBatch]):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content"), strict=True):
                path = f"{folder}/{name}.warc.zst"
                with open(unfinished := f"{path}.{uuid.uuid4().hex}", "wb") as out:
                    out.write(content.as_py())
                os.replace(unfinished, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return bundles.select("bundle", "content").mapInArrow(export, "path string")
