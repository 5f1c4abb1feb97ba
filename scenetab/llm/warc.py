"""WARC archives in seekable Zstandard bundles, written and read by tasks."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from base64 import b32encode, b64decode, b64encode
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.llm.common import hot_part, key128, new_folder, stored

# fixed values of the seekable format: a skippable frame with one entry per frame and a footer
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 24

INDEX = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()), ("frame_at", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
RECORDS = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """An address on one line of ASCII; what a well-formed address consists of stays, percent signs among it."""
    return re.sub(r"[\x00-\x20\x7f-\uffff]|[^\x00-\uffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_uuid(page_id: int | None, payload_digest: str) -> str:
    """The record id of the only row with this page id and payload."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{'' if page_id is None else page_id} {payload_digest}"))


def record(record_id: str, date: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, exact: bool = True) -> bytes:
    """A response with its HTTP message, or a revisit without a block. ``exact``: the response is the only row of its page id and payload."""
    sha = digest(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
        if _field(url) != url:
            head.append(f"X-Original-URI: {b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}"]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
            head += [f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to, sha)}>"] if exact else []
        body = b""
    else:
        head.append("Content-Type: application/http; msgtype=response")
        body = HTTP % len(payload) + payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at ``start`` and where the next one begins."""
    end = raw.index(b"\r\n\r\n", start)
    head = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b": "), b"") for line in raw[start:end].split(b"\r\n")[1:])
    n = int(head[b"Content-Length"])
    kind = head[b"WARC-Type"].decode()
    payload = raw[end + 4 : end + 4 + n].split(b"\r\n\r\n", 1)[1] if kind == "response" else None
    url = b64decode(head[b"X-Original-URI"]) if b"X-Original-URI" in head else head.get(b"WARC-Target-URI")
    found = {
        "record_id": head[b"WARC-Record-ID"][10:-1].decode(),
        "page_id": int(head[b"X-Page-ID"]) if b"X-Page-ID" in head else None,
        "url": None if url is None else url.decode("utf-8", "surrogatepass"),
        "payload": payload,
        "payload_bytes": int(head[b"X-Payload-Length"]) if payload is None else len(payload),
        "payload_digest": head[b"WARC-Payload-Digest"][5:].decode() if payload is None else digest(payload),
        "record_type": kind,
        "refers_to": int(head[b"X-Refers-To-Page"]) if b"X-Refers-To-Page" in head else None,
    }
    if head[b"WARC-Payload-Digest"][5:].decode() != found["payload_digest"]:
        raise ValueError(f"record {found['record_id']} does not match its digest")
    return found, end + 4 + n + 4


class Bundle:
    """Records in independent frames, then the seek table."""

    def __init__(self, level: int = 3):
        self.packer, self.out, self.frames = zstandard.ZstdCompressor(level=level), io.BytesIO(), []
        self.pending: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes) -> tuple[int, int, int, int]:
        """(frame number, where the frame begins in the file, offset within the frame, length)."""
        if self.size and self.size + len(raw) > FRAME_BYTES:
            self.flush()
        place = (len(self.frames), self.out.tell(), self.size, len(raw))
        self.pending.append(raw)
        self.size += len(raw)
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.frames.append((len(packed), self.size))
            self.out.write(packed)
            self.pending, self.size = [], 0

    def finish(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return self.out.getvalue()


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, size) of every frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    at, found = 0, []
    for packed, size in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        found.append((at, packed, size))
        at += packed
    return found


def frame(data: bytes, start: int, packed: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed])


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        bundle, index, name = Bundle(), [], f"{uuid.uuid4().hex}.warc.zst"

        def close():
            nonlocal bundle, index, name
            rows, data = index, bundle.finish()
            # a name of its own for each attempt: only bundles that the index names are read
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            bundle, index, name = Bundle(), [], f"{uuid.uuid4().hex}.warc.zst"
            return pa.RecordBatch.from_pylist(rows, schema=INDEX)

        for batch in batches:
            for r in batch.to_pylist():
                # equal rows can't share a record id, so each of them gets one of its own
                own = str(uuid.uuid4()) if r["repeated"] else record_uuid(r["page_id"], digest(r["payload"]))
                at = bundle.add(record(own, date, r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"], r["exact"]))
                index.append(dict(zip(INDEX.names, (own, name, *at))))
                if bundle.out.tell() >= BUNDLE_BYTES:
                    yield close()
        if index:
            yield close()

    return write


def _uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else re.sub(r"^file:/+", "file:///", path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write one record per row of ``pages`` into bundles under ``folder``; returns the stored index of the records.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response and the others
    are revisits of it; smaller payloads are all responses. Payloads are the text in UTF-8 (null: empty) and count as equal
    if SHA-1 and length are. Rows that repeat the largest id of a payload are responses too; a null id is smaller than any
    other, and a response only where no row of its payload has an id; texts of any length are one record; an empty table writes nothing;
    other columns are ignored, whatever their names.

    Responses hold an HTTP message around the payload; all records have the WARC-Date ``date`` (default: now) and their address as it is,
    but for blanks, control characters and letters beyond ASCII, which are escaped (the original is kept beside). The record id
    follows from page id and payload; where rows repeat both, all rows of that payload get random ones, and its revisits name the page
    only. The index maps each record id to its bundle, frame, the frame's place in the file and the offset within the unpacked frame.

    Who is the response is settled on narrow rows, hot payloads by broadcast. Page contents stay where they are if the revisits
    are few enough, by count, to be broadcast; else they move once, to meet the verdict.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    base = base.select("*", *key128(F.col("page_id"), F.col("url"), F.col("payload")))
    key = ["_k1", "_k2"]
    narrow = stored(base.select("page_id", *key, F.unhex(F.sha1("payload")).alias("_sha"), F.octet_length("payload").alias("_len")), "pages")
    same = narrow.groupBy("_sha", "_len", "page_id").agg(F.count(F.lit(1)).alias("_times"))
    payloads = same.groupBy("_sha", "_len").agg(F.max("page_id").alias("_first"), F.sum("_times").alias("_n"), (F.max("_times") == 1).alias("exact")).where("_n > 1")
    hot, rest = hot_part(stored(payloads, "payloads"), "_n")
    by_hot = narrow.join(F.broadcast(hot), ["_sha", "_len"])
    others = narrow.join(F.broadcast(hot.select("_sha", "_len")), ["_sha", "_len"], "left_anti").join(rest, ["_sha", "_len"])
    again = (F.col("_len") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    # where a payload has a repeated id, none of its rows goes by the id that follows from page and payload
    odd = by_hot.unionByName(others).select(*key, F.when(again, F.col("_first")).alias("refers_to"), again.alias("revisit"), "exact", (~F.col("exact")).alias("repeated"))
    odd = broadcast_if_small(stored(odd.where("revisit or repeated").dropDuplicates(key), "revisits"))
    no = F.lit(False)
    rows = base.join(odd, key, "left").select("page_id", "url", "payload", "refers_to", F.coalesce("revisit", no).alias("revisit"), F.coalesce("exact", no).alias("exact"), F.coalesce("repeated", no).alias("repeated"))
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    written = rows.mapInArrow(_writer(_uri(folder), date), "record_id string, bundle string, frame long, frame_at long, offset long, length long")
    return stored(written, "warc-index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data = row["content"]
            for start, packed, _ in seek_table(data):
                raw, at, found = frame(data, start, packed), 0, []
                while at < len(raw):
                    r, at = parse(raw, at)
                    found.append(r)
                yield pa.RecordBatch.from_pylist(found, schema=RECORDS)


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All records of the bundles that ``index`` names, frame by frame; each response is checked against its digest."""
    kind = "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if index.isEmpty():
        return spark.createDataFrame([], kind)
    # row 0 of a bundle: its name once, without shuffling the index
    names = index.where((F.col("frame") == 0) & (F.col("offset") == 0)).select("bundle")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("bundle", F.element_at(F.split("path", "/"), -1)).join(broadcast_if_small(names), "bundle", "left_semi")
    return files.select("content").mapInArrow(_reader, kind)


def fetch(bundle: bytes, frame_at: int, offset: int, length: int) -> dict:
    """One record by its index entry: only its frame is unpacked."""
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(bundle[frame_at:])
    return parse(raw[offset : offset + length])[0]


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write ``pages`` to a new shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    index = write_archives(pages, folder, **names)
    return read_archives(spark, folder, index)
