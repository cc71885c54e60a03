"""Token ids in sorted-string-table files.

A file holds (key, value) entries in ascending key order, and reads as

    block*  index  bloom  footer

A block's entries share key prefixes: varint shared, varint rest, varint value bytes, rest of the key,
value. Every ``RESTART`` entries a full key stands; the places of these follow the entries, then their
count, and a crc32 of all that. The index has for each block its last key, place and size; the Bloom
filter covers all keys; the fixed-size footer names the places of both, the counts and the id width. A
lookup asks the filter, finds the block by binary search in the index and the entry by binary search
over restarts. A key is the document's id (sign bit flipped, big-endian, after a byte that is 0 for a
null id) and its number among rows of that id; a value is the ids in 2 or 4 bytes each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.llm.common import map_rows
from ledgerlink.llm.words import coder
from ledgerlink.runtime import materialise, scratch

MAGIC = b"LLSST\0\0\1"
RESTART = 16
BLOCK_BYTES = 64 << 10
#: A range's writer starts another file at this size.
FILE_BYTES = 64 << 20
#: Rows that a range should hold, and the most ranges: their bounds are what the driver learns of the ids.
RANGE_ROWS = 16_384
MOST_RANGES = 4_096
BITS_PER_KEY = 10
PROBES = 7
_FOOTER = struct.Struct("<QQQQQQBxxxxxxx8s")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def encode_key(doc_id: int | None, number: int) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", number)


def decode_key(key: bytes) -> tuple[int | None, int]:
    number = struct.unpack(">I", key[9:])[0]
    return (None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)), number


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, seed=1) | 1
    return [(a + j * b) % bits for j in range(PROBES)]


class TableWriter:
    """Streams entries in key order to ``sink``; memory is a block and what the index and filter need."""

    def __init__(self, sink, width: int) -> None:
        self._sink, self._width = sink, width
        self._index: list[tuple[bytes, int, int]] = []
        self._hashes: list[bytes] = []
        self._at = self.entries = self.ids = 0
        self._begin()

    @property
    def size(self) -> int:
        return self._at + len(self._block)

    @property
    def bounds(self) -> tuple[bytes, bytes]:
        """The first and the last key written."""
        return self._hashes[0], self._hashes[-1]

    def _begin(self) -> None:
        self._block, self._restarts, self._count, self._last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self._hashes and key <= self._hashes[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self._count % RESTART:
            for x, y in zip(key, self._last, strict=False):
                if x != y:
                    break
                shared += 1
        else:
            self._restarts.append(len(self._block))
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self._last, self._count = key, self._count + 1
        self._hashes.append(key)
        self.entries += 1
        self.ids += len(value) // self._width
        if len(self._block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self._count:
            return
        body = bytes(self._block) + struct.pack(f"<{len(self._restarts) + 1}I", *self._restarts, len(self._restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self._sink.write(body)
        self._index.append((self._last, self._at, len(body)))
        self._at += len(body)
        self._begin()

    def finish(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self._index)
        bits = max(64, BITS_PER_KEY * self.entries)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self._hashes:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._sink.write(index + bloom.tobytes())
        self._sink.write(_FOOTER.pack(self._at, len(self._index), self._at + len(index), bits, self.entries, self.ids, self._width, MAGIC))


class TableReader:
    """Lookup and scan over a file's bytes, or over a file of which only what is needed is read.

    ``source`` is bytes, or an open random-access file: its footer, index and filter are read at once, a
    block when an entry of it is asked for.
    """

    def __init__(self, source: bytes | memoryview | pa.NativeFile) -> None:
        if isinstance(source, pa.NativeFile):
            size, self._read = source.size(), lambda at, n: memoryview(source.read_at(n, at))
        else:
            whole = memoryview(source)
            size, self._read = len(whole), lambda at, n: whole[at : at + n]
        index_at, blocks, bloom_at, self._bits, self.entries, self.ids, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table file")
        tail = self._read(index_at, size - _FOOTER.size - index_at)
        self._bloom = tail[bloom_at - index_at :]
        self._blocks: list[tuple[int, int]] = []
        self._keys: list[bytes] = []
        at = 0
        for _ in range(blocks):
            n, at = _read_varint(tail, at)
            self._keys.append(bytes(tail[at : at + n]))
            place, at = _read_varint(tail, at + n)
            size, at = _read_varint(tail, at)
            self._blocks.append((place, size))

    def _block(self, k: int) -> tuple[memoryview, tuple[int, ...]]:
        data = self._read(*self._blocks[k])
        body = data[:-4]
        if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        n = struct.unpack("<I", body[-4:])[0]
        return body[: -4 * (n + 1)], struct.unpack(f"<{n}I", body[-4 * (n + 1) : -4])

    @staticmethod
    def _entries(block: memoryview, at: int) -> Iterator[tuple[bytes, memoryview]]:
        key = b""
        while at < len(block):
            shared, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:shared] + bytes(block[at : at + rest])
            yield key, block[at + rest : at + rest + size]
            at += rest + size

    def _may_hold(self, key: bytes) -> bool:
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self._bits))

    def get(self, key: bytes) -> bytes | None:
        if not self._may_hold(key):
            return None
        k = bisect_left(self._keys, key)
        if k == len(self._keys):
            return None
        block, restarts = self._block(k)
        first = bisect_left(restarts, True, key=lambda at: next(self._entries(block, at))[0] > key)
        for found, value in self._entries(block, restarts[max(0, first - 1)]):
            if found >= key:
                return bytes(value) if found == key else None
        return None

    def scan(self) -> Iterator[tuple[bytes, memoryview]]:
        for k in range(len(self._blocks)):
            yield from self._entries(self._block(k)[0], 0)


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _ranges(docs: DataFrame) -> list[int]:
    """Bounds that split the ids into ranges of about ``RANGE_ROWS`` rows, ``MOST_RANGES`` at most."""
    n = docs.count()
    parts = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    if parts == 1:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * MOST_RANGES)).first()[0]
    return sorted(set(found or []))


def write_tables(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, width: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and write table files below ``folder``, a URI that all executors share.

    Returns the manifest: part, number, path, entries, ids, first_key, last_key. Files are named by range and number and
    renamed into place when whole, so a task that runs again replaces its own files by the same.
    """
    width = width or (2 if max(coder(vocabulary).size, end_id + 1) <= 1 << 16 else 4)
    kind = f"<u{width}"

    def make():
        own = coder(vocabulary)
        end = np.array([end_id], kind).tobytes()

        def work(ids: list, texts: list) -> dict:
            return {"doc_id": ids, "ids": [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in own.encode([t or "" for t in texts])]}

        return work

    bounds = _ranges(docs)
    coded = map_rows(docs, "doc_id long, ids binary", make)
    # how many bounds lie below the id: its range; a null id sorts first
    part = F.coalesce(F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    dealt = coded.withColumn("part", part.cast("int")).repartitionById(len(bounds) + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        fs.create_dir(root, recursive=True)
        open_: tuple | None = None

        def close() -> pa.RecordBatch:
            table, sink, part, number, draft = open_
            table.finish()
            sink.close()
            final = f"{root}/part-{part:06d}-{number:06d}.sst"
            fs.move(draft, final)
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": f"{folder}/{final.rsplit('/', 1)[1]}", "entries": table.entries, "ids": table.ids, "first_key": table.bounds[0], "last_key": table.bounds[1]}], schema=schema)

        last = object()
        copy = 0
        for batch in batches:
            for doc, ids, part in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "ids", "part")], strict=True):
                copy = copy + 1 if last == (part, doc) else 0
                last = (part, doc)
                if open_ and (open_[2] != part or open_[0].size >= FILE_BYTES):
                    number = open_[3] + 1 if open_[2] == part else 0
                    yield close()
                    open_ = None
                else:
                    number = 0
                if not open_:
                    draft = f"{root}/.draft-{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(draft)
                    open_ = (TableWriter(sink, width), sink, part, number, draft)
                open_[0].add(encode_key(doc, copy), ids)
        if open_:
            yield close()

    return materialise(ordered.mapInArrow(write, "part int, number int, path string, entries long, ids long, first_key binary, last_key binary"), "sst-manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry of the files, in the files' order of ids.

    ``start`` is the number of ids before the entry: of files before its own, a running sum over the
    manifest (a row for each file), and of entries before it, from the file.
    """
    before = F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(1, min(manifest.count(), 10_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, place = _files(path)
                with fs.open_input_file(place) as f:
                    table = TableReader(f.read())
                rows = []
                for key, value in table.scan():
                    ids = np.frombuffer(value, f"<u{table.width}")
                    rows.append((decode_key(key)[0], base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    base += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Ids of the asked documents (their first row).

    Only files whose keys may span an asked one are opened, and of those the footer, index and filter are
    read, and a block where the filter lets a key through.
    """
    keys = F.array(*[F.lit(encode_key(d, 0)) for d in doc_ids]).cast("array<binary>")
    files = manifest.where(F.exists(keys, lambda k: (k >= F.col("first_key")) & (k <= F.col("last_key"))))
    out: dict[int, np.ndarray] = {}
    for row in files.select("path", "first_key", "last_key").toLocalIterator():
        fs, place = _files(row.path)
        with fs.open_input_file(place) as f:
            table = TableReader(f)
            for d in doc_ids:
                key = encode_key(d, 0)
                if bytes(row.first_key) <= key <= bytes(row.last_key) and (value := table.get(key)) is not None:
                    out[d] = np.frombuffer(value, f"<u{table.width}").astype(np.uint32)
    return out


def token_tables(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each row's whole text as ids to table files in ascending id order and read them back.

    Null and empty texts hold the end id alone; null ids come first; rows of one id stay, in the order
    of their ids' bytes. An empty table writes no file and gives no row. Other columns are not read.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return read_tables(write_tables(plain, folder or scratch(docs.sparkSession, "sst"), vocabulary, end_id))
