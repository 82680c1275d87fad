"""BPE encoding by speculation and verification, vectorised over many distinct words.

Greedy longest match proposes tokens for all words at once. A tokenisation is the one that merging
would give exactly if every adjacent pair of its tokens is compatible, that is, if merging the two
tokens' own text would give just these two. The pairs of all words are checked together by undoing
merges in numpy; only words with an incompatible pair, or without a full proposal, go through exact
merging.

Ids and texts: see ``WordEncoder``. A null or empty text has no ids and decodes to an empty text.
Any columns other than the text pass through ``encode_decode`` unchanged.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.columns import text_list, with_computed
from webloom.llm.tokens import ENTRY_BYTES, byte_alphabet, load_tokenizer, vocabulary_path

_FAR = np.int64(1) << 40
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """uint64 key -> int64 value by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        at = ((keys * _STEP) >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.values[at[todo]] < 0
            _, first = np.unique(np.where(free, at[todo], -1 - np.arange(len(todo))), return_index=True)
            take = todo[first[free[first]]]
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            todo = np.setdiff1d(todo, take)
            at[todo] = (at[todo] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * _STEP) >> self.shift).astype(np.int64)
        out = self.values[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.values[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        return out


class SpeculativeBpe:
    """The merges of one vocabulary over byte words; ``end_mark`` is the byte that closes a word."""

    #: Words of more bytes go to exact merging at once.
    LONGEST = 48

    def __init__(self, name_or_path: str):
        with open(vocabulary_path(name_or_path), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.exact = load_tokenizer(name_or_path).model
        suffix = model.get("end_of_word_suffix") or ""
        self.end_mark = b"\xff" if suffix else b""
        alphabet = byte_alphabet()
        self.alphabet = dict(enumerate(alphabet))
        back = {c: b for b, c in enumerate(alphabet)}
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1

        def raw(token: str) -> bytes | None:
            closed = bool(suffix) and token.endswith(suffix) and token != suffix
            body = token[: -len(suffix)] if closed else token
            if any(c not in back for c in body):
                return None
            return bytes(back[c] for c in body) + (self.end_mark if closed else b"")

        self.left = np.arange(size)
        self.right = np.arange(size)
        self.rank = np.full(size, -1, np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pair_keys, ranks = [], []
        for k, (a, b) in enumerate(merges):
            made = vocab[a + b]
            if self.rank[made] < 0 and len(raw(a + b) or b"") > 1 + (a + b).endswith(suffix or "\0"):
                self.left[made], self.right[made], self.rank[made] = vocab[a], vocab[b], k
            pair_keys.append((vocab[a] << 32) | vocab[b])
            ranks.append(k)
        self.pairs = _Table(np.array(pair_keys, np.uint64), np.array(ranks, np.int64))
        rng = np.random.default_rng(20240229)
        self.byte_code = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = np.uint64(0xD6E8FEB86659FD93)
        inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        powers = np.ones(1 << 20, np.uint64)
        powers[1:] = self.base
        self.powers = np.multiply.accumulate(powers)
        powers[1:] = inverse
        self.inverses = np.multiply.accumulate(powers)
        whole = [(raw(t), i, t) for t, i in vocab.items()]
        kept = [(r, i) for r, i, t in whole if r and len(r) <= self.LONGEST and self._is_own(t, i)]
        self.longest = max(len(r) for r, _ in kept)
        joined = b"".join(r for r, _ in kept)
        ends = np.cumsum([len(r) for r, _ in kept])
        starts = ends - np.array([len(r) for r, _ in kept])
        self.tokens = _Table(self._hash(self._prefix(joined), starts, ends), np.array([i for _, i in kept], np.int64))

    def _is_own(self, token: str, i: int) -> bool:
        """Does merging the token's own text give the token? Others are never proposed."""
        if self.end_mark:
            if not token.endswith("</w>"):
                return True  # checked through its pairs: the library closes every word
            token = token[:-4]
        return [t.id for t in self.exact.tokenize(token)] == [i]

    def _prefix(self, joined: bytes) -> np.ndarray:
        codes = self.byte_code[np.frombuffer(joined, np.uint8)]
        while len(codes) >= len(self.powers):
            half = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * self.powers[half - 1 : half] * self.base])
            self.inverses = np.concatenate([self.inverses, self.inverses * self.inverses[half - 1 : half] * self.inverses[1]])
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.powers[: len(codes)], dtype=np.uint64)])

    def _hash(self, prefix, start, end):
        """A hash of bytes start..end that depends on their content and count only."""
        return (prefix[end] - prefix[start]) * self.inverses[start] + (end - start).astype(np.uint64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would merging their joined text leave just these two?"""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _FAR)
        while len(live):
            across = self.pairs.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            broken = (across >= 0) & (across < limit)
            ok[live[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~broken & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            on_left = ra > rb
            limit = np.where(on_left, ra, rb + 1)
            a, b = np.where(on_left, self.right[a], a), np.where(on_left, b, self.left[b])
        return ok

    def propose(self, joined: bytes, starts: np.ndarray, ends: np.ndarray):
        """Greedy tokens of all words: (word, token) in order, and which words got a full proposal."""
        prefix = self._prefix(joined)
        full = np.ones(len(starts), bool)
        live, at = np.arange(len(starts)), starts.copy()
        words, tokens = [], []
        mark = 1 if self.end_mark else 0
        while len(live):
            rest = ends[live] - at
            found = np.full(len(live), -1, np.int64)
            step = np.zeros(len(live), np.int64)
            for n in range(min(self.longest, int(rest.max())), 0, -1):
                open_ = np.flatnonzero((found < 0) & (rest >= n) & ((rest != n + 1) if mark else True))
                if len(open_):
                    p = at[open_]
                    hit = self.tokens.get(self._hash(prefix, p, p + n))
                    got = hit >= 0
                    found[open_[got]] = hit[got]
                    step[open_[got]] = n
            lost = found < 0
            full[live[lost]] = False
            words.append(live[~lost])
            tokens.append(found[~lost])
            at = at + step
            go = ~lost & (at < ends[live])
            live, at = live[go], at[go]
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order], full

    def merge_exactly(self, word: bytes) -> list[int]:
        """The library's own merging of one word."""
        return [t.id for t in self.exact.tokenize(word.decode("latin-1").translate(self.alphabet))]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words end to end, how many each has, and how many words needed exact merging."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
        marked = [w + self.end_mark for w in words] if self.end_mark else words
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(lengths)
        short = np.flatnonzero((lengths <= self.LONGEST) & (lengths > len(self.end_mark)))
        of, tokens, full = self.propose(b"".join(marked), (ends - lengths)[short], ends[short])
        same = of[1:] == of[:-1]
        if len(of) > 1:
            ok = self.compatible(tokens[:-1][same], tokens[1:][same])
            full[of[1:][same][~ok]] = False
        exact = np.ones(len(words), bool)
        exact[short[full]] = False
        redo = np.flatnonzero(exact)
        merged = [self.merge_exactly(words[i]) if words[i] else [] for i in redo]
        good = full[of]
        counts = np.bincount(short[of[good]], minlength=len(words))
        counts[redo] = [len(m) for m in merged]
        out = np.empty(int(counts.sum()), np.uint32)
        hole = np.repeat(exact, counts)
        out[~hole] = tokens[good]
        out[hole] = np.fromiter((i for m in merged for i in m), np.uint32, int(counts[redo].sum()))
        return out, counts, len(redo)


class _Seen(dict):
    """Piece -> slot; an unknown piece gets the next slot and waits to be encoded."""

    def __init__(self, owner):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece):
        slot = self.owner.slots
        self.owner.slots += 1
        self.owner.held += len(piece) + ENTRY_BYTES
        self.owner.waiting.append((piece, self is self.owner.first))
        self[piece] = slot
        return slot


class SlotEncoder:
    """Ids of many texts at once; ``max_pieces`` and ``max_bytes`` bound the cache of a worker."""

    def __init__(self, name_or_path: str, max_pieces: int = 600_000, max_bytes: int = 128 << 20):
        self.tokenizer = load_tokenizer(name_or_path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_pieces, self.max_bytes = max_pieces, max_bytes
        self.reset()

    def reset(self):
        self.slots, self.waiting, self.held = 0, [], 0
        self.first, self.rest = _Seen(self), _Seen(self)
        self.flat = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.start = np.empty(1 << 16, np.int64)
        self.length = np.empty(1 << 16, np.int32)
        self.hits = np.zeros(1 << 16, np.int32)
        self.filled = 0

    def _age(self):
        """Forget the pieces that were met once; the others keep their ids under new slots."""
        keep = self.hits[: self.filled] > 1
        if keep.sum() > self.max_pieces // 2:
            self.reset()
            return
        slot = np.cumsum(keep) - 1
        old_start, lengths = self.start[: self.filled][keep], self.length[: self.filled][keep].astype(np.int64)
        sizes = np.maximum(lengths, 0)
        to = np.cumsum(sizes)
        ids = self.flat[np.repeat(old_start - (to - sizes), sizes) + np.arange(int(to[-1]) if len(to) else 0)]
        old = [(self.first, dict(self.first)), (self.rest, dict(self.rest))]
        hits = self.hits[: self.filled][keep]
        self.first.clear()
        self.rest.clear()
        for seen, items in old:
            seen.update((piece, int(slot[k])) for piece, k in items.items() if keep[k])
        self.held = sum(len(piece) + ENTRY_BYTES for seen, _ in old for piece in seen)
        if self.held > self.max_bytes // 2:
            self.reset()
            return
        self.slots = self.filled = len(sizes)
        self.start[: self.filled], self.length[: self.filled] = to - sizes, lengths
        self.hits[:] = 0
        self.hits[: self.filled] = hits // 2 + 1
        self.flat[: len(ids)], self.used = ids, len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32), and the end of each text among them (int64)."""
        if self.slots > self.max_pieces or self.held > self.max_bytes:
            self._age()
        slots, ends = [], np.zeros(len(texts), np.int64)
        first, rest = self.first, self.rest.__getitem__
        for i, text in enumerate(texts):
            pieces = text.split(" ")
            slots.append(first[pieces[0]])
            slots.extend(map(rest, itertools.islice(pieces, 1, None)))
            ends[i] = len(slots)
        self._absorb()
        slots = np.array(slots, np.int64)
        self.hits[: self.filled] += np.bincount(slots, minlength=self.filled)[: self.filled].astype(np.int32)
        lengths = self.length[slots] if len(slots) else np.zeros(0, np.int32)
        bad = np.flatnonzero(lengths < 0)
        whole = np.unique(np.searchsorted(ends, bad, side="right")) if len(bad) else ()
        lengths = np.maximum(lengths, 0).astype(np.int64)
        to = np.cumsum(lengths)
        total = int(to[-1]) if len(to) else 0
        shift = np.repeat(self.start[slots] - (to - lengths), lengths)
        ids = self.flat[shift + np.arange(total)] if total else np.zeros(0, np.uint32)
        id_ends = np.concatenate([[0], to])[ends]
        if len(whole):
            parts, begin = [], np.concatenate([[0], id_ends[:-1]])
            replaced = {int(i): np.array(e.ids, np.uint32) for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False))}
            for i in range(len(texts)):
                parts.append(replaced[i] if i in replaced else ids[begin[i] : id_ends[i]])
            ids = np.concatenate(parts)
            id_ends = np.cumsum([len(p) for p in parts])
        return ids, id_ends


class WordEncoder(SlotEncoder):
    """Whole-text ids of a word-end BPE vocabulary (lower case, white space dropped).

    White space never joins two words here, so every space is a safe place to cut. The library
    normalises each distinct piece, its public pattern gives the words, and ``SpeculativeBpe`` encodes
    them; a text with the string of a special token goes through the library whole.
    """

    def __init__(self, name_or_path: str, max_pieces: int = 600_000, max_bytes: int = 128 << 20):
        super().__init__(name_or_path, max_pieces, max_bytes)
        self.bpe = SpeculativeBpe(name_or_path)
        with open(vocabulary_path(name_or_path), encoding="utf-8") as f:
            whole = json.load(f)
        steps = whole["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.token_bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.token_bytes[i] = token.encode()

    def _absorb(self):
        words, bounds, unsafe = [], [0], []
        for piece, _ in self.waiting:
            bad = "<" in piece and any(s in piece for s in self.specials)
            unsafe.append(bad)
            if not bad:
                plain = piece.lower() if piece.isascii() else self.normalize(piece)
                words += [w.encode() for w in self.split.findall(plain)]
            bounds.append(len(words))
        slot = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, counts, _ = self.bpe.encode_words(list(slot))
        to = np.cumsum(counts)
        which = np.array([slot[w] for w in words], np.int64)
        sizes = counts[which] if len(which) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        shift = np.repeat((to - counts)[which] - (ends - sizes), sizes) if len(which) else np.zeros(0, np.int64)
        flat = ids[shift + np.arange(len(shift))] if len(shift) else np.zeros(0, np.uint32)
        marks = np.concatenate([[0], ends])[bounds].astype(np.int64)
        n, at = self.filled + len(unsafe), self.used + len(flat)
        if n > len(self.start):
            self.start = np.concatenate([self.start, np.empty(n, np.int64)])
            self.length = np.concatenate([self.length, np.empty(n, np.int32)])
            self.hits = np.concatenate([self.hits, np.zeros(n, np.int32)])
        if at > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(at, np.uint32)])
        self.start[self.filled : n] = self.used + marks[:-1]
        self.length[self.filled : n] = np.where(unsafe, -1, np.diff(marks))
        self.flat[self.used : at] = flat
        self.filled, self.used, self.waiting = n, at, []

    def decode(self, ids: np.ndarray) -> bytes:
        """As this vocabulary's library decodes, special tokens included: its tokens joined by spaces."""
        return b" ".join([self.token_bytes[i] for i in ids.tolist()])


_WORD_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(name_or_path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary."""
    if name_or_path not in _WORD_ENCODERS:
        _WORD_ENCODERS[name_or_path] = WordEncoder(name_or_path)
    return _WORD_ENCODERS[name_or_path]


OUTPUT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
    ]
)


def encode_decode(docs: DataFrame, text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``docs`` plus ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and the text ``decoded`` from them."""

    def make():
        words = word_encoder(vocabulary)

        def compute(texts):
            ids, ends = words.encode(text_list(texts))
            begins = np.concatenate([[0], ends[:-1]])
            parts = [ids[a:b].astype("<u4") for a, b in zip(begins, ends)]
            return [ends - begins, [p.tobytes() for p in parts], [words.decode(p).decode() for p in parts]]

        return compute

    return with_computed(docs, [text_col], OUTPUT, make, max_chars=1_000_000)


def digest_columns(encoded: DataFrame) -> DataFrame:
    """The columns of the query: counts, and digests of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
