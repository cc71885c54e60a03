"""Dictionary-compressed WARC archives.

An archive begins with a skippable frame that holds a Zstandard dictionary built from its own records;
each record follows as a frame of its own, compressed with that dictionary, so any record can be read
alone. The first record is a ``warcinfo``. A record's id is its archive's uuid and its number there, so
ids are unique also where rows repeat; pages are named by the extension fields ``X-Page-ID`` and
``X-Refers-To-Page-ID``. Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest page id is a
response; the others are revisits that name it and carry no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.runtime import materialise, scratch

LEAST = 100
#: Magic number of the skippable frame that holds a dictionary (fixed by the format).
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: A dictionary is built from the first records of its archive: so many bytes, at most so much of each.
SAMPLE_BYTES = 2 << 20
SAMPLE_EACH = 16 << 10
#: An archive is closed at this many bytes.
FILE_BYTES = 256 << 20
LEVEL = 3
#: Records carry one fixed date, so that a task that runs again writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
#: Decisions are broadcast up to so many rows, so that payloads stay where they are; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(value: str) -> str:
    """A header value: control characters would end the line, so they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def info(archive: str) -> bytes:
    """The record that tells what an archive is."""
    block = b"software: ledgerlink\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(archive, 0)}", f"WARC-Date: {DATE}", f"WARC-Filename: {archive}.warc.zst", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(archive), str(number))}>"


def record(ident: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A whole WARC record of id ``ident``. A revisit needs the payload's size only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {ident}",
        f"WARC-Target-URI: {_line(url or 'about:blank')}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To-Target-URI: {_line(refers_url or 'about:blank')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict | None:
    """Fields of a record, None for a ``warcinfo``; the payload of a response is hashed anew, a revisit's is what its HTTP head tells."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    if fields["warc-type"] == "warcinfo":
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    response = fields["warc-type"] == "response"
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if response and (len(payload) != told or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")
    ident = lambda field: int(fields[field]) if field in fields else None
    return {"page_id": ident("x-page-id"), "url": fields["warc-target-uri"], "payload": payload if response else None, "payload_bytes": told, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": ident("x-refers-to-page-id"), "record_id": fields["warc-record-id"]}


def build_dictionary(samples: list[bytes]) -> bytes:
    """Trained where there are enough samples, else the samples themselves as a raw dictionary."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * 4096:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too alike to train on
    return b"".join(samples)[-DICTIONARY_BYTES:]


class ArchiveWriter:
    """Writes records to ``sink``; holds back the first ``SAMPLE_BYTES`` until the dictionary is built."""

    def __init__(self, sink, archive: str) -> None:
        self._sink, self._archive, self._held, self._held_bytes, self._zip = sink, archive, [info(archive)], 0, None
        self.size = self.records = 0

    def _start(self) -> None:
        raw = build_dictionary([r[:SAMPLE_EACH] for r in self._held])
        frame = zstandard.ZstdCompressor(level=19).compress(raw)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(frame)) + frame)
        self._zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
        for r in self._held:
            self._put(self._zip.compress(r))
        self._held = []

    def _put(self, data: bytes) -> None:
        self._sink.write(data)
        self.size += len(data)

    def add(self, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, refers_url: str | None) -> None:
        self.records += 1
        data = record(record_id(self._archive, self.records), page_id, url, payload, size, digest, refers_to, refers_url)
        if self._zip:
            self._put(self._zip.compress(data))
            return
        self._held.append(data)
        self._held_bytes += len(data)
        if self._held_bytes >= SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if not self._zip:
            self._start()
        self._sink.close()


def read_archive(source) -> Iterator[dict]:
    """Records of one archive in order, a frame at a time."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(source.read(n))
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = b""
    while True:
        rest = rest or source.read(1 << 20)
        if not rest:
            return
        frame, out = unzip.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := source.read(1 << 20)):
                raise ValueError("an archive ends inside a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        if (found := parse(b"".join(out))) is not None:
            yield found


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, of, refers_to, refers_url) of the revisits among (page_id, url, payload): slim rows, no payloads.

    The smallest id of a digest is a partial aggregate; the join back is by digest on slim rows.
    """
    slim = materialise(pages.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")), "warc-digests")
    place = F.struct("page_id", "url")
    first = slim.where((F.col("size") >= LEAST)).groupBy("digest").agg(F.min("page_id").alias("first"), F.min(F.when(F.col("page_id").isNotNull(), place))["url"].alias("refers_url"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = slim.select("page_id", "digest").join(first, "digest")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.where(other).select("page_id", F.col("first").alias("refers_to"), "refers_url", F.col("digest").alias("of")).distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload) below ``folder``, a URI that all executors share.

    Returns the manifest (path, records). Archives are written as drafts and renamed when whole; only
    archives in the manifest count, so a task that ran twice leaves no record twice.
    """
    decided = materialise(decide(pages), "warc-revisits")
    if decided.count() <= BROADCAST_ROWS:
        decided = F.broadcast(decided)
    with_digest = pages.withColumn("digest", F.sha2("payload", 256))
    # only copies appear among the decisions; the digest keeps rows of one id with other payloads apart
    joined = with_digest.join(decided, with_digest["page_id"].eqNullSafe(decided["page_id"]) & (with_digest["digest"] == decided["of"]), "left").select(with_digest["page_id"], "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), "digest", "refers_to", "refers_url")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now: tuple[ArchiveWriter, str, str] | None = None

        def close() -> pa.RecordBatch:
            now[0].close()
            fs.move(now[1], now[2])
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{now[2].rsplit('/', 1)[1]}", "records": now[0].records}], schema=schema)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now and now[0].size >= FILE_BYTES:
                    yield close()
                    now = None
                if not now:
                    name = uuid.uuid4().hex
                    now = (ArchiveWriter(fs.open_output_stream(f"{root}/.draft-{name}", compression=None), name), f"{root}/.draft-{name}", f"{root}/{name}.warc.zst")
                now[0].add(*row)
        if now:
            yield close()

    return materialise(joined.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives of a manifest, a task for each archive, a record at a time."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("url", pa.string()), ("payload", pa.binary()), ("record_id", pa.string())] if payloads else []
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                rows: list[dict] = []
                size = 0
                with fs.open_input_stream(place, compression=None) as f:
                    for r in read_archive(f):
                        rows.append({k: r[k] for k, _ in fields})
                        size += len(r["payload"] or b"") if payloads else 100
                        if size > 4 << 20 or len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, min(manifest.count(), 10_000))
    more = ", url string, payload binary, record_id string" if payloads else ""
    return manifest.select("path").repartition(n).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + more)


def archive_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive each row and read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty
    payload, a null url ``about:blank``, a null id an id of its own that sorts after all others (such a
    row revisits the smallest id of its payload, if there is one). Repeated rows with one id are all the
    response. An empty table writes nothing. Other columns are not read.
    """
    plain = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.encode(F.col(f"`{html_col}`"), "UTF-8"), F.lit(b"")).alias("payload"))
    return read_archives(write_archives(plain, folder or scratch(pages.sparkSession, "warc")))
