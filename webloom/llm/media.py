"""Texts as media columns: content-addressed payloads in tar shards.

Each task of the writing pass keeps one open tar shard in the shared folder. A payload (the text's bytes,
filled up with zeros) is stored once in a shard, as a lossless greyscale PNG of 8-bit samples under its
digest; the row carries digest, shard, offset and length. Rows with the same digest then agree on one
stored copy. A second pass goes through the shards in order: the header of each file, read alone, fills
the metadata columns, and the whole file gives the samples back.

Copies are dropped within a shard as it is written; copies in different shards stay until
compaction, since dropping them first would shuffle every payload.

Null handling: a null text is empty, and its payload is one unit of zeros. Repeated ids keep all rows, equal texts
have equal values. A very long text is one payload; shards close behind the file that fills them. An empty table
gives no shards. Other columns are not looked at.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.columns import text_list
from webloom.llm.skew import join_hot, often
from webloom.llm.stores import open_store
from webloom.session import materialize, ship, work_path

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
UNIT = 64

ROWS = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 4) -> bytes:
    """One row of 8-bit grey samples."""
    header = struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(b"\0" + payload, level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first ``HEADER_BYTES`` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples of a file that ``encode_png`` made."""
    width, height, _ = read_header(data[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != height * (width + 1):
        raise ValueError("wrong size")
    return raw[1:] if height == 1 else b"".join(raw[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height))


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and how they fall on eight equal ranges."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, level = counts.sum(), np.arange(256)
    mean = float((counts * level).sum() / n)
    spread = float(np.sqrt((counts * (level - mean) ** 2).sum() / n))
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    return f"{mean:.6f};{spread:.6f};{abs(entropy):.6f};" + ",".join(map(str, counts.reshape(8, 32).sum(1).tolist()))


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 28) -> DataFrame:
    """Store every text; one row per document with its digest and place. Written once, then read."""
    ship(docs.sparkSession)
    store, where = open_store(path)
    store.create_dir(where, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_store(path)
        sink = tar_at = shard = None
        known: dict[bytes, tuple[str, int, int]] = {}
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, text in zip(ids, text_list(batch.column(1))):
                data = text.encode()
                payload = padded(data)
                digest = hashlib.sha256(payload).digest()
                if digest not in known:
                    if sink is None or tar_at > shard_bytes:
                        if sink is not None:
                            sink.write(bytes(1024))
                            sink.close()
                        shard = f"{folder}/shard-{uuid.uuid4().hex}.tar"
                        sink, tar_at = fs.open_output_stream(shard), 0
                        known.clear()
                    stored = encode_png(payload)
                    info = tarfile.TarInfo(digest.hex() + ".png")
                    info.size = len(stored)
                    sink.write(info.tobuf(tarfile.USTAR_FORMAT))
                    sink.write(stored)
                    sink.write(bytes(-len(stored) % 512))
                    known[digest] = (shard, tar_at + 512, len(stored))
                    tar_at += 512 + len(stored) + -len(stored) % 512
                rows.append((i, len(data), digest, *known[digest]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                )
        if sink is not None:
            sink.write(bytes(1024))
            sink.close()

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return materialize(narrow.mapInArrow(run, ROWS), "media-rows")


FACTS = (
    "digest binary, width long, height long, bits int, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def read_media(entries: DataFrame, path: str, range_bytes: int = 1 << 28) -> DataFrame:
    """Facts of each stored payload (digest, shard, offset, length), from ranges of the shards."""
    ship(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(path)
        source, opened = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != opened:
                    if source is not None:
                        source.close()
                    source, opened = fs.open_input_file(shard), shard
                width, height, bits = read_header(source.read_at(HEADER_BYTES, offset))
                stored = source.read_at(length, offset)
                payload = decode_png(stored)
                sha = hashlib.sha256(payload)
                if sha.digest() != digest:
                    raise ValueError(f"payload at {shard}:{offset} has another digest")
                rows.append(
                    (digest, width, height, bits, len(payload), sha.hexdigest(), zlib.crc32(payload[-UNIT:]),
                     len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload))
                )
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = [c.strip().split(" ")[0] for c in FACTS.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if source is not None:
            source.close()

    total = entries.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    in_order = entries.select("digest", "shard", "offset", "length").repartitionByRange(n, "shard", "offset")
    return in_order.sortWithinPartitions("shard", "offset").mapInArrow(run, FACTS)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its digest, where its payload is stored, and what reading it back gives."""
    path = work_path(docs.sparkSession, "media")
    rows = write_media(docs, path, id_col, text_col)
    place = F.min(F.struct("shard", "offset", "length")).alias("at")
    stored = materialize(rows.groupBy("digest").agg(place, F.count("*").alias("rows")).select("digest", "at.*", "rows"), "media-index")
    facts = read_media(stored, path).withColumnRenamed("digest", "_digest")
    places = stored.withColumnRenamed("digest", "_of")
    facts = materialize(facts.join(places, F.col("_digest") == F.col("_of")).drop("_of"), "media-facts")
    found = join_hot(rows.select("doc_id", "n_bytes", "digest"), facts, F.col("digest") == F.col("_digest"), often("rows", rows.count()))
    return found.drop("_digest", "rows")


def digest_columns(media: DataFrame) -> DataFrame:
    return media.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "bits",
    )
