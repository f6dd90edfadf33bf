"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the seek table of the public seekable format (a
skippable frame with the compressed and full size of every frame), and an index maps each record to its frame and its
offset within the frame, so one record is read with one seek. Bundles are written by the tasks into the shared folder under
fresh names and count only through the manifest that Spark commits, so retried tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, open_fs, shuffle_parts, work_dir, write_bytes

#: Fixed values of the seekable format: the skippable frame's magic number and the seek table's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, path string, frame int, at long, size long"


def choose_originals(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, sha1, payload_bytes, refers_to and refers_to_url: the page that a revisit refers to, else null.

    Of rows with one payload of at least ``least`` bytes the largest page_id is the original (then the largest url); further
    rows with that very page_id are originals too. Null html is empty, null urls are empty, null page_ids are never referred
    to unless no other has the payload. Digests are counted before the join, so a payload that a third of all rows share
    brings one row to it, and the join's own side can be split; smaller payloads meet nothing there and are spread.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("payload_bytes"))
    large = rows.filter(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count(F.lit(1)).alias("n"))
    copied = materialize(large.filter("n > 1").select(F.col("sha1").alias("met"), F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url")), "warc-originals")
    met = F.when(F.col("payload_bytes") >= least, F.col("sha1")).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("met", met).join(copied, "met", "left")
    other = F.col("original") != F.col("page_id")
    return joined.select("page_id", "url", "html", "sha1", "payload_bytes", F.when(other, F.col("original")).alias("refers_to"), F.when(other, F.col("original_url")).alias("refers_to_url"))


def record(place: str, page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None, refers_to_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head with the payload's length and digest, and no payload.

    place (bundle, frame and offset) makes the record's id, so pages that share a page_id have ids of their own; a revisit
    names the record it refers to by target and date.
    """
    line = lambda u: u.replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {line(url)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {line(refers_to_url or '')}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    body = entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(fs, path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, full size) of every frame, from the bundle's end."""
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        f.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        f.seek(size - 9 - 8 * n)
        table = np.frombuffer(f.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(table[:, 0])])
    return [(int(a), int(c), int(d)) for a, (c, d) in zip(at, table)]


def parse(raw: bytes) -> dict:
    """Header fields, payload bytes and payload length of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return fields | {"payload": payload, "payload_length": length}


def write_archives(originals: DataFrame, folder: str, frame_bytes: int = 256_000, bundle_bytes: int = 64_000_000, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write choose_originals' rows as bundles into folder; returns the index (columns of INDEX) of every record.

    Frames close at frame_bytes of records and bundles at bundle_bytes, whatever a task holds; one record is never cut.
    The result must be committed once (materialize): it names the files that count.
    """

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        now: list[bytes] = []
        done: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        index: list[tuple] = []
        path, held = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0

        def close_frame() -> None:
            nonlocal now, held
            if now:
                raw = b"".join(now)
                done.append(press.compress(raw))
                sizes.append((len(done[-1]), len(raw)))
                now, held = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal done, sizes, index, path
            close_frame()
            write_bytes(path, [*done, seek_table(sizes)])
            columns = list(zip(*index))
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["page_id", "path", "frame", "at", "size"])
            done, sizes, index, path = [], [], [], f"{folder}/{uuid.uuid4().hex}.warc.zst"
            return made

        for frame in frames:
            for page_id, url, html, sha1, refers, refers_url in zip(*(frame.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to", "refers_to_url"))):
                raw = record(f"{path}#{len(sizes)}.{held}", page_id, url, html.encode(), sha1, refers, refers_url, date)
                index.append((page_id, path, len(sizes), held, len(raw)))
                now.append(raw)
                held += len(raw)
                if held >= frame_bytes:
                    close_frame()
                    if sum(map(len, done)) >= bundle_bytes:
                        yield close_bundle()
        if index:
            yield close_bundle()

    return originals.select("page_id", "url", "html", "sha1", "refers_to", "refers_to_url").mapInArrow(write, INDEX)


def read_archives(index: DataFrame) -> DataFrame:
    """Read every record that an index names: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    Frames are dealt to the tasks; each is found by its bundle's seek table and its records by their offsets within it. A
    response whose payload doesn't have its digest raises an error.
    """
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress, tables = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for path, number, ats, record_sizes in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "ats", "sizes"))):
                fs, local = open_fs(path)
                if path not in tables:
                    tables = {path: read_seek_table(fs, local)}
                at, packed, full = tables[path][number]
                with fs.open_input_file(local) as f:
                    f.seek(at)
                    raw = unpress.decompress(f.read(packed), max_output_size=full)
                rows = []
                for a, n in zip(ats, record_sizes):
                    x = parse(raw[a : a + n])
                    digest = base64.b32decode(x["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if x["WARC-Type"] == "response" and hashlib.sha1(x["payload"]).hexdigest() != digest:
                        raise ValueError(f"payload of {x['WARC-Record-ID']} in {path} is damaged")
                    to = x.get("X-Refers-To-Page")
                    rows.append((int(x["X-Page-ID"]) if x["X-Page-ID"] else None, x["WARC-Target-URI"], x["WARC-Type"], digest, x["payload_length"], int(to) if to else None, x["payload"] if x["WARC-Type"] == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    dealt = index.repartition(shuffle_parts(index.sparkSession), "path", "frame")  # small rows that stand for much work: not to be coalesced
    frames = dealt.groupBy("path", "frame").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("r"))
    return frames.select("path", "frame", F.col("r.at").alias("ats"), F.col("r.size").alias("sizes")).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as WARC bundles and return their committed index.

    Null html and urls are empty, a null page_id stays null, rows that repeat are records each with ids of their own, ties for
    the original go to the larger url, a very long page is one record in a frame of its own; an empty table makes no bundle and
    an empty index; other columns, whatever they are called, are ignored.
    """
    folder = folder or work_dir(pages.sparkSession, "warc")
    return materialize(write_archives(choose_originals(pages), folder), "warc-index")
