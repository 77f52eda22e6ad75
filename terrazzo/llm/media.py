"""Content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG of a fixed width, so losslessly and compressed, under its SHA-256 in
the tar shard of the task that met it; equal payloads of a task are stored once. Rows carry digest, shard,
offset and length of the stored form. Metadata come from range reads of its first 33 bytes; features from
the stored bytes read back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ddl, map_batches
from .session import shared_folder

WIDTH = 192
FILL = b" "
#: Digests that a task remembers (about 300 bytes each); a payload that it has forgotten is stored again.
MOST_SEEN = 200_000
HEADER = 33  # PNG's signature and its IHDR chunk
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
STORED = "doc_id long, n_bytes long, digest string, media_bytes long, media_sha256 string, shard string, offset long"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8, filled up to a positive multiple of WIDTH, and its length before that."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + FILL * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits per sample) from a PNG's first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples of what encode_png() made."""
    width, height, _ = read_header(data[:HEADER])
    at, body = HEADER, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes, width: int = WIDTH) -> str:
    x = np.frombuffer(payload, np.uint8)
    quarters = np.bincount(x >> 5, minlength=8)
    return f"{width}x{len(x) // width};mean={x.mean():.4f};std={x.std():.4f};hist={'/'.join(map(str, quarters.tolist()))}"


def store_payloads(docs: DataFrame, folder: str) -> DataFrame:
    """Write each partition's distinct payloads as one tar shard in `folder`, a URI that pyarrow can open; one row of STORED per input row.

    A shard is written under another name and then moved, so a task that is run again replaces it by the
    same bytes. The result reads the checkpointed rows: payloads are written once.
    """
    kind = ddl(STORED)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}.tar"
        where.create_dir(root, recursive=True)
        hidden = f"{root}/_{name}.{task.taskAttemptId()}"
        at, seen = 0, {}
        with where.open_output_stream(hidden) as out:
            for b in batches:
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    payload, n = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in seen:
                        if len(seen) >= MOST_SEEN:
                            seen.clear()
                        media = encode_png(payload)
                        head = tarfile.TarInfo(f"{digest}.png")
                        head.size = len(media)
                        head = head.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + media + bytes(-len(media) % 512))
                        seen[digest] = len(media), hashlib.sha256(media).hexdigest(), at + len(head)
                        at += len(head) + len(media) + -len(media) % 512
                    size, media_sha, offset = seen[digest]
                    rows.append((doc_id, n, digest, size, media_sha, name, offset))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            out.write(bytes(1024))
        where.move(hidden, f"{root}/{name}")

    return docs.select("doc_id", "text").mapInArrow(run, kind).checkpoint()


def _ranged(stored: DataFrame, folder: str, length: int | None, read, schema: str) -> DataFrame:
    """`stored` with `schema` by read(bytes) for each row: of its first `length` bytes, or all. A range is read once in a task."""
    out_kind = ", ".join([*(f"{n} {'long' if t == 'bigint' else t}" for n, t in stored.dtypes), schema])

    def run(rows: list[list]) -> Iterator[tuple]:
        where, root = pafs.FileSystem.from_uri(folder)
        seen: dict = {}
        last, f = None, None
        for row in zip(*rows, strict=True):
            size, shard, offset = row[3], row[5], row[6]
            if (shard, offset) not in seen:
                if shard != last:
                    last, f = shard, where.open_input_file(f"{root}/{shard}")
                seen[shard, offset] = read(f.read_at(size if length is None else min(size, length), offset))
            yield (*row, *seen[shard, offset])

    return map_batches(stored, run, out_kind, stored.columns)


def with_metadata(stored: DataFrame, folder: str) -> DataFrame:
    """`stored` with width, height and sample_bits, from header-only range reads."""
    return _ranged(stored, folder, HEADER, read_header, "width int, height int, sample_bits int")


def with_content(stored: DataFrame, folder: str) -> DataFrame:
    """`stored` with payload_bytes, payload_sha256, tail_crc32 and feature of the stored bytes read back."""

    def read(data: bytes) -> tuple:
        p = decode_png(data)
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), feature_of(p), hashlib.sha256(data).hexdigest()

    return _ranged(stored, folder, None, read, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, read_sha256 string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, where it lies, and width, height, sample_bits.

    A null text is an empty one: a payload of one line of spaces. A null doc_id stays null; repeated rows
    each give a row, with equal values; an empty table gives none; other columns are ignored. A very long text is one payload, in memory
    while it is stored and read. Equal payloads of a task are stored once, unless MOST_SEEN others came between them.
    folder: the default is a new one in the shared checkpoint folder. Map-only.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    got = with_content(with_metadata(store_payloads(docs, folder), folder), folder)
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("read_sha256").alias("media_sha256"), "feature", "shard", "offset", "width", "height", "sample_bits")
