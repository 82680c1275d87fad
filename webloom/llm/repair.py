"""Token-id files compressed by a Re-Pair grammar, written and read back by tasks.

Documents are dealt out by ranges of their id, each range sorted, so that file after file holds them
in ascending order. A file is a row of blocks; each block has its own grammar: frequent id pairs are
replaced by nonterminals round after round until none is left, and the rules are stored with their expansion
lengths. Where each block lies in its file, and which ids it holds, is in the manifest, and again behind the
blocks of the file; the block's index gives where each document begins in the compressed sequence. So one
document, or a span of it, is decoded from its own block alone, without what stands before it.

Block layout, little-endian: magic ``WLRP0002``; uint32 counts (documents, rules, symbols, base), a byte
each for the bits of a symbol and of a length, and two of zero; per document int64 id, uint32 number of
ids, uint32 first symbol, and a byte that says whether the id is null; then three rows of numbers of as
many bits as the largest takes, highest bit first, each filled up to a byte: left and right of every rule,
the rules' expansion lengths, and the symbols. A file ends with int64 offset, length and ids before it of every
block, and int64 number of blocks.

Null handling: a null text is empty and holds only the end id; rows without an id come first; repeated
ids keep all their rows, in any order among themselves. A very long text is one document of its block, which
then exceeds ``block_ids``. An empty table gives no files. Other columns are not looked at.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.columns import text_list, text_parts
from webloom.llm.stores import open_store, parts_for
from webloom.llm.tokens import encoder
from webloom.session import materialize, ship, work_path

MAGIC = b"WLRP0002"
HEAD = struct.Struct("<8s4I2B2x")
HASH = np.uint64(0x9E3779B97F4A7C15)
MANIFEST = "part int, path string, block int, offset long, n_bytes long, start long, n_docs long, n_tokens long, first_id long, last_id long"


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of matches that overlap, every second one, counted from the left (a mask)."""
    if not len(at):
        return np.zeros(0, bool)
    head = np.concatenate([[True], np.diff(at) > 1])
    place = np.arange(len(at))
    return (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0


def _where(mask: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
    """What a mask marks of each; places are looked for once."""
    at = np.flatnonzero(mask)
    return [row.take(at) for row in rows]


def _slots(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code in ``wanted`` or -1, and whether it may be wanted at all.

    Of wanted codes with the same hash the first one is found, and the others only may be wanted.
    """
    bits = max(10, len(wanted).bit_length() + 2)

    def place(c):
        c = c * HASH
        c >>= np.uint64(64 - bits)
        return c.view(np.int64)

    table = np.full(1 << bits, -1, np.int32)
    hashed, first = np.unique(place(wanted), return_index=True)
    table[hashed] = first
    slot = table.take(place(codes))
    may = slot >= 0
    wrong = wanted.take(slot, mode="wrap") != codes
    slot[wrong] = -1
    return slot, may


def build_grammar(ids: np.ndarray, last: np.ndarray, base: int, least: int = 6):
    """(symbols, is-last-of-document, rules); a pair never reaches over the end of a document.

    Rounds go on until no pair occurs ``least`` times. A round counts all pairs and replaces the frequent ones
    where no more frequent pair overlaps; those that this leaves with fewer places wait for the next count. The
    commonest pair gives way to none, so each round makes a rule. Pairs of old symbols never become more
    frequent, so those found to be rare are not counted again; of overlapping pairs of one symbol, every second
    one counts.
    """
    rules: list[np.ndarray] = []
    symbols, next_id = ids.astype(np.uint32), base
    last = last.copy()
    live = ~last  # does a pair begin here that may be frequent?
    live[-1:] = False
    while True:
        at = np.flatnonzero(live)
        left, right = symbols.take(at), symbols.take(at + 1)
        codes = left.astype(np.uint64)
        codes <<= np.uint64(32)
        codes |= right
        same = np.flatnonzero(left == right)
        if len(same):
            kept = np.ones(len(at), bool)
            kept[same[~_alternate(at[same])]] = False
            at, codes = _where(kept, at, codes)
        del left, right
        seen, count = np.unique(codes, return_counts=True)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        # pairs of one count in the order of a hash: in the order of ids, a long passage could give one rule a round
        best = seen[often[np.lexsort((seen[often] * HASH, -count[often]))]]
        slot, may = _slots(codes, best)
        live[at[~may]] = False
        at, slot = _where(slot >= 0, at, slot)
        touch = np.diff(at) == 1
        free = np.ones(len(at), bool)
        free[1:] &= ~touch | (slot[1:] < slot[:-1])
        free[:-1] &= ~touch | (slot[:-1] < slot[1:])
        at, slot = _where(free, at, slot)
        used = np.bincount(slot, minlength=len(best)) >= least
        stays = used[slot]
        at, slot, best = at[stays], (np.cumsum(used) - 1)[slot[stays]], best[used]
        symbols[at] = next_id + slot
        last[at] = last[at + 1]
        live[at] = ~last[at]
        before = at[at > 0] - 1
        live[before] = ~last[before]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        # where two replaced pairs follow each other, the place before the second one is gone; the first is live
        symbols, last, live = _where(keep, symbols, last, live)
        rules.append(np.stack([best >> np.uint64(32), best & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        next_id += len(best)
    return symbols.astype(np.int64), last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def pack(values: np.ndarray, bits: int) -> bytes:
    """Numbers below 2**bits in so many bits each."""
    left = (values.astype(np.uint64) << np.uint64(32 - bits)).astype(">u4")  # the bits stand at the front
    return np.packbits(np.unpackbits(left.view(np.uint8).reshape(-1, 4), axis=1, count=bits)).tobytes() if bits else b""


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    left = np.zeros((n, 4), np.uint8)
    left[:, : -(-bits // 8)] = np.packbits(np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits), axis=1)
    return (left.view(">u4").ravel().astype(np.uint64) >> np.uint64(32 - bits)).astype(np.uint32)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat expansions of all symbols that have rules, and where each begins (one more than rules).

    Rules refer to earlier ones only, so stretches of rules that do not refer to each other go together.
    """
    flat, starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
    newest = rules.max(1).astype(np.int64) - base if len(rules) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(rules):
        inside = newest[begin:] >= begin
        end = begin + int(inside.argmax()) if inside.any() else len(rules)
        pairs = rules[begin:end].astype(np.int64).ravel()
        sizes = np.where(pairs >= base, np.diff(starts)[np.maximum(pairs - base, 0)] if begin else 1, 1)
        flat = np.concatenate([flat, expand(pairs, flat, starts, base)])
        starts = np.concatenate([starts, starts[-1] + np.cumsum(sizes.reshape(-1, 2).sum(1))])
        begin = end
    return flat, starts


def expand(symbols: np.ndarray, flat: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """The ids that a stretch of symbols stands for."""
    rule = symbols.astype(np.int64) - base
    made = rule >= 0
    begin = np.where(made, starts[np.maximum(rule, 0)], 0)
    sizes = np.where(made, starts[np.maximum(rule, 0) + 1] - begin if len(starts) > 1 else 1, 1)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(begin - (ends - sizes), sizes) + np.arange(total)
    plain = np.repeat(~made, sizes)
    out = np.empty(total, np.uint32)
    out[plain] = symbols[~made]
    out[~plain] = flat[at[~plain]]
    return out


def encode_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, last, rules = build_grammar(ids, last, base)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(doc_ids) else np.zeros(0)
    _, starts = expansions(rules, base)
    lengths = np.diff(starts)
    bits, length_bits = (base + len(rules)).bit_length(), int(lengths.max(initial=0)).bit_length()
    null = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join(
        [
            HEAD.pack(MAGIC, len(doc_ids), len(rules), len(symbols), base, bits, length_bits),
            np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
            counts.astype("<u4").tobytes(),
            first.astype("<u4").tobytes(),
            null.tobytes(),
            pack(rules.ravel(), bits),
            pack(lengths, length_bits),
            pack(symbols, bits),
        ]
    )


class Block:
    """A block as read from a file; documents are decoded one by one or in one go."""

    def __init__(self, source):
        head = source.read(HEAD.size)
        magic, docs, rules, symbols, self.base, bits, length_bits = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token block")
        take = lambda kind, n: np.frombuffer(source.read(np.dtype(kind).itemsize * n), kind)
        self.doc_ids, self.counts, self.first = take("<i8", docs), take("<u4", docs), take("<u4", docs)
        self.null = take("u1", docs)
        packed = lambda n, width: unpack(source.read(-(-n * width // 8)), n, width)
        self.rules = packed(2 * rules, bits).reshape(rules, 2)
        self.lengths = packed(rules, length_bits)
        self.symbols = packed(symbols, bits)
        self.flat, self.starts = expansions(self.rules, self.base)

    def document(self, k: int, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of document ``k``; stored lengths lead to the symbols."""
        end = int(self.first[k + 1]) if k + 1 < len(self.first) else len(self.symbols)
        symbols = self.symbols[int(self.first[k]) : end].astype(np.int64)
        sizes = np.where(symbols >= self.base, self.lengths[np.maximum(symbols - self.base, 0)] if len(self.lengths) else 1, 1)
        to = np.cumsum(sizes)
        stop = int(self.counts[k]) if count is None else min(int(self.counts[k]), start + count)
        a, b = np.searchsorted(to, start, side="right"), np.searchsorted(to, stop, side="left") + 1
        before = int(to[a - 1]) if a else 0
        return expand(symbols[a:b], self.flat, self.starts, self.base)[start - before : stop - before]

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols.astype(np.int64), self.flat, self.starts, self.base)


def file_index(blocks: list[tuple[int, int, int]]) -> bytes:
    """What closes a file, from (offset, length, ids before it) of its blocks."""
    return np.array(blocks, "<i8").tobytes() + struct.pack("<q", len(blocks))


def read_index(source, size: int) -> list[tuple[int, int, int]]:
    """The blocks of an open file of ``size`` bytes, from its end."""
    source.seek(size - 8)
    (n,) = struct.unpack("<q", source.read(8))
    source.seek(size - 8 - 24 * n)
    return [tuple(row) for row in np.frombuffer(source.read(24 * n), "<i8").reshape(n, 3).tolist()]


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 2,
    block_ids: int = 2_000_000,
    file_bytes: int = 1 << 28,
) -> DataFrame:
    """Write the files and return their manifest, a row for each block; ``start`` counts ids within the file.

    A task that runs again writes a file of another name; the manifest lists the ones that count. There are as many
    files as ``file_bytes`` of text ask for.
    """
    spark = docs.sparkSession
    ship(spark)
    store, where = open_store(path)
    store.create_dir(where, recursive=True)
    names = [c.strip().split(" ")[0] for c in MANIFEST.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary).encode
        closing = np.array([end_id], np.uint32).tobytes()
        base = encoder(vocabulary).tokenizer.get_vocab_size(with_added_tokens=True)
        fs, folder = open_store(path)
        target = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.wlrp"
        sink, offset, before, rows = None, 0, 0, []
        doc_ids, counts, held, size = [], [], [], 0

        def flush():
            nonlocal sink, offset, before, doc_ids, counts, held, size
            block = encode_block(doc_ids, np.array(counts), np.concatenate(held), base)
            sink = sink or fs.open_output_stream(target)
            sink.write(block)
            known = [i for i in doc_ids if i is not None]
            ends = (known[0], known[-1]) if known else (None, None)
            rows.append((part, target, len(rows), offset, len(block), before, len(doc_ids), size, *ends))
            offset, before = offset + len(block), before + size
            doc_ids, counts, held, size = [], [], [], 0

        for batch in batches:
            for some in text_parts(batch, 1, min(block_ids, 2_000_000)):
                own, ends = encode(text_list(some.column(1)), closing)
                n = np.diff(np.concatenate([[0], ends]))
                doc_ids += some.column(0).to_pylist()
                counts += n.tolist()
                held.append(own)
                size += len(own)
                if size >= block_ids:
                    flush()
        if doc_ids:
            flush()
        if sink:
            sink.write(file_index([r[3:6] for r in rows]))
            sink.close()
            kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    files = parts_for(narrow, "text", file_bytes)
    sorted_ = narrow.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return materialize(sorted_.mapInArrow(run, MANIFEST), "token-manifest")


def _open_block(fs, path: str, offset: int, size: int) -> Block:
    with fs.open_input_file(path) as source:
        return Block(io.BytesIO(source.read_at(size, offset)))


STORED = "doc_id long, start long, n_tokens long, ids binary"


def _stored(block: Block, rows: list[int], starts: list[int], ids: list[bytes]) -> pa.RecordBatch:
    null = block.null[rows].astype(bool)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.doc_ids[rows], pa.int64(), mask=null),
            pa.array(starts, pa.int64()),
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array(ids, pa.binary()),
        ],
        names=["doc_id", "start", "n_tokens", "ids"],
    )


def _placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start`` counted over all files: a row for each file goes through the driver."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    at, before = 0, []
    for r in parts:
        before.append((r["part"], at))
        at += r["n"]
    offsets = manifest.sparkSession.createDataFrame(before, "part int, ids_before long")
    return manifest.join(offsets, "part").withColumn("start", F.col("start") + F.col("ids_before")).drop("ids_before")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(path)
        for batch in batches:
            for file, offset, size, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                block = _open_block(fs, file, offset, size)
                ids = block.all_ids().astype("<u4")
                ends = np.cumsum(block.counts.astype(np.int64))
                begins = ends - block.counts
                for a in range(0, len(ends), 512):
                    z = min(a + 512, len(ends))
                    own = [ids[b:e].tobytes() for b, e in zip(begins[a:z], ends[a:z])]
                    yield _stored(block, list(range(a, z)), (begins[a:z] + start).tolist(), own)

    blocks = _placed(manifest).select("path", "offset", "n_bytes", "start")
    tasks = max(1, blocks.count())
    return blocks.repartition(min(tasks, 10_000), "path", "offset").mapInArrow(run, STORED)


def read_documents(manifest: DataFrame, path: str, doc_ids: list[int], first: int = 0, count: int | None = None) -> DataFrame:
    """Ids ``first`` to ``first + count`` of some documents, decoded from their own blocks only; columns as above.

    ``start`` is where the span begins among all ids. Each id's documents, if it is repeated, give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(path)
        for batch in batches:
            for file, offset, size, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                block = _open_block(fs, file, offset, size)
                rows = np.flatnonzero(np.isin(block.doc_ids, doc_ids) & (block.null == 0)).tolist()
                if rows:
                    begins = np.cumsum(block.counts.astype(np.int64)) - block.counts
                    ids = [block.document(k, first, count).astype("<u4").tobytes() for k in rows]
                    yield _stored(block, rows, (begins[rows] + start + first).tolist(), ids)

    inside = F.exists(F.lit(list(doc_ids)).cast("array<long>"), lambda i: i.between(F.col("first_id"), F.col("last_id")))
    return _placed(manifest).where(inside).select("path", "offset", "n_bytes", "start").mapInArrow(run, STORED)


def digest_columns(stored: DataFrame) -> DataFrame:
    """The columns of the query."""
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def token_store_roundtrip(docs: DataFrame) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back."""
    path = work_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path), path)
