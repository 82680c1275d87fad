"""Whole-text token ids of a byte-level BPE tokenizer, computed batch by batch inside tasks.

A space that follows a character other than white space always begins a new pre-token in this
family of tokenizers. So a text may be cut there, and the ids of each cut piece be looked up in a
cache that lives as long as the Python worker; the tokenizers library encodes each distinct piece
once. Texts for which the cut would not be safe (runs of white space, text that looks like a special
token) go through the library whole.
"""

from __future__ import annotations

import gc
import itertools
import operator
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterable

import numpy as np
import regex

#: Fixed value: the public pattern by which this family of vocabularies splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts of ASCII characters.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

#: Marks that are a pre-token of their own behind a word.
MARKS = frozenset(",.;:!?)%$#&*")

_MODELS: dict[str, object] = {}


def vocabulary_path(name_or_path: str) -> str:
    """A file path as it is; a bare name is looked up among the installed public vocabularies."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def load_tokenizer(name_or_path: str):
    """The library's tokenizer without truncation or padding, one per worker."""
    found = _MODELS.get(name_or_path)
    if found is None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(vocabulary_path(name_or_path))
        found.no_truncation()
        found.no_padding()
        _MODELS[name_or_path] = found
    return found


def byte_alphabet() -> list[str]:
    """The printable stand-in for each of the 256 bytes, by the public byte-level rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


_ID = operator.attrgetter("id")


class _Unsafe(Exception):
    """A text that must go through the library whole."""


#: What an entry of a cache takes besides its characters and ids: two objects and a place in the table.
ENTRY_BYTES = 200


class _Pieces(dict):
    """Piece -> its ids as bytes. Pieces that a whole generation did not meet are forgotten.

    A generation ends when it holds ``limit`` pieces or ``max_bytes``.
    """

    def __init__(self, encode, limit: int, max_bytes: int):
        super().__init__()
        self.encode, self.limit, self.max_bytes, self.older, self.held = encode, limit, max_bytes, {}, 0

    def __missing__(self, piece):
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        self.held += len(piece) + len(ids) + ENTRY_BYTES
        return ids

    def age(self):
        if len(self) > self.limit or self.held > self.max_bytes:
            self.older = dict(self)
            self.clear()
            self.held = 0

    def forget(self):
        """Keep this generation alone."""
        self.older = {}


class PieceEncoder:
    """Ids of many texts at once; ``max_pieces`` and ``max_bytes`` bound a generation of a worker's cache."""

    def __init__(self, name_or_path: str, max_pieces: int = 250_000, max_bytes: int = 128 << 20):
        self.tokenizer = load_tokenizer(name_or_path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.alphabet = "".join(byte_alphabet())
        self.space = self.alphabet[ord(" ")]
        self.merge = self.model.tokenize
        self.words = _Pieces(self._word, max_pieces // 2, max_bytes // 4)
        self.rest = _Pieces(self._behind_space, max_pieces, max_bytes // 2)
        self.first = _Pieces(lambda piece: self._piece(piece, piece, self.first) if piece else b"", max_pieces // 8, max_bytes // 8)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # these bytes stand for themselves, but for the space
            plain = word.replace(" ", self.space)
        else:
            plain = charmap_decode(word.encode(), "strict", self.alphabet)[0]
        return array("I", map(_ID, self.merge(plain))).tobytes()

    def _behind_space(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():  # most new pieces: no further call
            return array("I", map(_ID, self.merge(self.space + piece))).tobytes()
        return self._piece(" " + piece, piece, self.rest)

    def _piece(self, whole: str, piece: str, pieces: _Pieces) -> bytes:
        if piece.isalpha():  # the cache of pieces will hold it: that of words need not
            return self._word(whole)
        if piece[:-1].isalpha() and piece[-1] in MARKS:
            return pieces[piece[:-1]] + self.words[piece[-1]]
        if not piece or piece[-1].isspace() or any([s in piece for s in self.specials]):
            raise _Unsafe
        split = self.split_ascii if whole.isascii() else self.split
        return b"".join(map(self.words.__getitem__, split(whole)))

    def encode_one(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers."""
        pieces = text.split(" ")
        try:
            head = self.first[pieces[0]]
            return head + b"".join(map(self.rest.__getitem__, itertools.islice(pieces, 1, None)))
        except _Unsafe:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def rest_between_tasks(self):
        for cache in (self.words, self.rest, self.first):
            cache.forget()

    def encode(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32), and the end of each text among them (int64).

        ``end`` (ids as unsigned 32-bit integers) closes every text.
        """
        for cache in (self.words, self.rest, self.first):
            cache.age()
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and collections in between take a sixth of the time
        try:
            parts = list(map(self.encode_one, texts))
        finally:
            if collects:
                gc.enable()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + len(end)
        return np.frombuffer(end.join([*parts, b""]), np.uint32), np.cumsum(sizes // 4)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(name_or_path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary."""
    if name_or_path not in _ENCODERS:
        _ENCODERS[name_or_path] = PieceEncoder(name_or_path)
    return _ENCODERS[name_or_path]


def forget_encoders() -> None:
    """For tasks that need none: a worker that encoded for another stage drops its vocabularies and caches."""
    if not _MODELS:
        return
    for own in _ENCODERS.values():
        for cache in (own.words, own.rest, own.first):
            cache.clear()
            cache.forget()
    _ENCODERS.clear()
    _MODELS.clear()
    gc.collect()  # encoder and caches refer to each other


def spans(sizes: Iterable[int], max_chars: int = 4_000_000):
    """Index ranges of consecutive texts of these sizes that hold about ``max_chars`` together."""
    begin, end, size = 0, 0, 0
    for n in sizes:
        end += 1
        size += n
        if size >= max_chars:
            yield begin, end
            begin, size = end, 0
    if begin < end:
        yield begin, end


def slices(texts: list[str], max_chars: int = 4_000_000):
    """Index ranges of consecutive texts that hold about ``max_chars`` together."""
    return spans(map(len, texts), max_chars)
