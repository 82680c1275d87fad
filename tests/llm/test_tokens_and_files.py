"""Tokenisation, packing, token files and media against the library and brute force."""

import hashlib
import io
import math
import random
import statistics
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webloom.llm import bpe, media, packing, repair, tokens

ODD = [
    None, "", " ", "  ", "\n", "a", "a  b", " a", "a ", "x\n y", "don't  'll", "é  b", "a　b", "a\tb c", "12 3a!! ?", "ñ́ x", "a\r\n b",
    "<|endoftext|>", "a <|endoftext|>b", "word, word. word;word", "x" * 5000, "日本語 テキスト", "ΑΣ Σας", "\x1c a\x1cb", "a b", "ﬁ ½ Ⅷ ²", "😀 a😀b",
]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("thernadiéß,.") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    rows = [(i, t, "x", 1.5) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 900]))), "y", 2.5) for i in range(60)]
    rows += [(100, rows[-1][1], "again", 0.0), (None, "no id", "z", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, Score string, ids double")


def pairs(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def test_byte_vocabulary_as_the_library():
    texts = [t or "" for t in ODD]
    ids, ends = tokens.PieceEncoder("byte_bpe_50k.json", max_pieces=5).encode(texts)
    wanted = [e.ids for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == wanted


def random_texts(n):
    rng = random.Random(20)
    bits = [*"aZ1.,-'(\"", " ", "  ", "\n", "\t", "\x00", "\x07", "\x1b[0m", "\x7f", "\x85", "\xa0", "é", "ß", "ñ", "日本", "🙂", "\u200d", "'s", "'ll", "12", "...", "word", "The", "²", "́", "<|endoftext|>", "<", "|>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_random_texts_as_the_library():
    texts = random_texts(20_000)
    ids, ends = tokens.PieceEncoder("byte_bpe_50k.json").encode(texts)
    wanted = [e.ids for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == wanted
    ids, ends = bpe.word_encoder("word_bpe_49k.json").encode(texts)
    wanted = [e.ids for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == wanted


def test_word_vocabulary_as_the_library(spark, docs):
    t = library("word_bpe_49k.json")
    encoded = bpe.encode_decode(docs)
    assert "Score" in encoded.columns and encoded.columns.count("ids") == 1
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_columns(encoded).collect() if r["doc_id"] is not None)
    wanted = []
    for i, text in pairs(docs):
        if i is not None:
            e = t.encode(text, add_special_tokens=False).ids
            sha = hashlib.sha256
            wanted.append((False, i, len(e), sha(np.array(e, "<u4").tobytes()).hexdigest(), sha(t.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(wanted)


def test_speculation_is_verified():
    b = bpe.SpeculativeBpe("word_bpe_49k.json")
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdehnorst") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)})
    ids, counts, redone = b.encode_words(words)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [b.merge_exactly(w) for w in words]
    assert 0 < redone < len(words)


def test_packing_covers_every_token(spark, docs):
    t = library("byte_bpe_50k.json")
    rows = packing.best_fit_packing(docs.where("doc_id <> 100")).collect()
    by, filled = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for i, text in pairs(docs.where("doc_id <> 100")):
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 2], 0
        total += len(ids)
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(filled) <= 1.05 * math.ceil(total / 1024) + 1


def fewest(sizes, capacity):
    """Fewest bins, by search."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                go(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 100])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = packing.Plan({n: sizes.count(n) for n in set(sizes)}, capacity)
        assert fewest(sizes, capacity) <= plan.sequences <= math.ceil(11 / 9 * fewest(sizes, capacity) + 6 / 9)
        if plan.fixed == plan.sequences:
            assert plan.sequences == fewest(sizes, capacity)


def test_token_files_round_trip(spark, docs):
    t = library("byte_bpe_50k.json")
    got = repair.digest_columns(repair.token_store_roundtrip(docs)).collect()
    at, seen = 0, sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[0])
    assert [r[1] for r in seen] == [None, *sorted(i for i, _ in pairs(docs) if i is not None)]
    texts = {}
    for i, text in pairs(docs):
        texts.setdefault(i, []).append(np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4"))
    for start, i, n, crc in seen:
        assert start == at and (n, crc) in [(len(e), zlib.crc32(e.tobytes())) for e in texts[i]]
        at += n


def test_single_documents_from_token_files(spark, docs, tmp_path):
    t = library("byte_bpe_50k.json")
    manifest = repair.write_token_files(docs, f"file://{tmp_path}", block_ids=3000)
    whole = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in repair.read_token_files(manifest, f"file://{tmp_path}").collect()}
    assert manifest.count() > 8 and len(whole) == docs.count()
    wanted = [100, 103, 7, 999]
    got = repair.read_documents(manifest, f"file://{tmp_path}", wanted).collect()
    assert sorted((r["doc_id"], r["start"]) for r in got) == sorted(k for k in whole if k[0] in wanted)
    assert all(bytes(r["ids"]) == whole[r["doc_id"], r["start"]] for r in got)
    text = dict(pairs(docs))[103]
    part = repair.read_documents(manifest, f"file://{tmp_path}", [103], 2, 5).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in part] == [t.encode(text, add_special_tokens=False).ids[2:7]]
    for r in manifest.groupBy("path").agg({"block": "count"}).collect():
        with open(r["path"], "rb") as f:
            index = repair.read_index(f, f.seek(0, 2))
            assert len(index) == r["count(block)"]
            for offset, size, _ in index:
                f.seek(offset)
                assert len(repair.Block(io.BytesIO(f.read(size))).doc_ids)


def test_grammar_decodes_at_random():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 300, 80)
    ids = rng.integers(0, 6, counts.sum()).astype(np.uint32)
    block = repair.Block(io.BytesIO(repair.encode_block(list(range(80)), counts, ids, base=6)))
    assert len(block.rules) and len(block.symbols) < len(ids) and np.array_equal(block.all_ids(), ids)
    ends = np.cumsum(counts)
    for k in range(80):
        own = ids[ends[k] - counts[k] : ends[k]]
        assert np.array_equal(block.document(k), own) and np.array_equal(block.document(k, 5, 9), own[5:14])


def png(payload):
    """One row of grey samples, written out from the format's definition."""
    out = bytes([137, 80, 78, 71, 13, 10, 26, 10])
    for kind, data in ((b"IHDR", len(payload).to_bytes(4, "big") + bytes([0, 0, 0, 1, 8, 0, 0, 0, 0])), (b"IDAT", zlib.compress(b"\0" + payload, 4)), (b"IEND", b"")):
        out += len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return out


def test_media_round_trip(spark, docs):
    got = media.digest_columns(media.media_columns(docs)).collect()
    assert len(got) == docs.count()
    texts = {}
    for i, text in pairs(docs):
        texts.setdefault(i, []).append(text.encode())
    by_payload = {}
    for r in got:
        options = []
        for data in texts[r["doc_id"]]:
            p = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            options.append((len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in options
        assert (r["width"] * r["height"], r["bits"]) == (r["payload_bytes"], 8)
        by_payload.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
        data = next(d for d, o in zip(texts[r["doc_id"]], options) if o[2] == r["payload_sha256"])
        payload = data.ljust(r["payload_bytes"], b"\0")
        stored = png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        level = statistics.fmean(payload), statistics.pstdev(payload)
        share = [payload.count(b) / len(payload) for b in set(payload)]
        entropy = -sum(p * math.log2(p) for p in share)
        figures = [float(x) for x in r["feature"].split(";")[:3]]
        assert all(abs(a - b) < 2e-6 for a, b in zip(figures, [*level, entropy]))
        assert r["feature"].split(";")[3] == ",".join(str(sum(b // 32 == k for b in payload)) for k in range(8))
    assert all(len(v) == 1 for v in by_payload.values())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.encode_decode(none).count() == 0
    assert packing.best_fit_packing(none).count() == 0
    assert repair.token_store_roundtrip(none).count() == 0
    assert media.media_columns(none).count() == 0
