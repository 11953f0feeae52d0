"""Token ids of whole texts by a public byte-level BPE, encoded once for each distinct piece of text.

Byte-level BPE cuts a text into words before it merges, and a single space between two characters that are not
white space always starts a word there. So a text's ids are those of its pieces between such spaces, each
encoded with its space by the tokenizers library and kept in a bounded cache of the task. A piece that is new
is put together from its words, which have a cache of their own. A text in which white space stands beside white
space, or at its end, or that holds the string of an added token, is encoded whole instead.

By default an added token's string gets that token's id, as the library gives it for a file that it has just loaded;
plain=True makes it ordinary text, for corpora that must not write control tokens.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache, partial
from itertools import accumulate
from string import punctuation

import numpy as np
import regex

#: Distinct pieces, and distinct words, in one generation of a task's caches; about 200 bytes each.
CACHE_PIECES = 400_000
#: The published word pattern of this family of tokenizers.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: The published mapping of bytes to printable characters of this family: what is not printable moves beyond 255.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

SPACE_CHAR = chr(BYTE_CHARS[32])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str, plain: bool):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = plain
    return out


class _Awkward(Exception):
    """White space that may belong to either side."""


class _Cache(dict):
    """What was used lately: when a generation is full it becomes the old one, from which entries in use move on."""

    __slots__ = ("make", "old")

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str):
        made = self.old.get(piece)
        if made is None:
            made = self.make(piece)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = made
        return made


class Encoder:
    """Ids and character offsets of whole texts, equal to those of one call over the text."""

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = _tokenizer(path, plain)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special))
        self.tokenize = self.tokenizer.model.tokenize
        self._word_ids = _Cache(self._word)
        self._word_starts = _Cache(self._starts_in_word)
        self._ids = _Cache(self._piece_ids)
        self._first_ids = _Cache(partial(self._piece_ids, space=""))
        self._starts = _Cache(self._piece_starts)

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pattern, by the library's model alone."""
        if word.isascii() and word.isprintable():
            mapped = word.replace(" ", SPACE_CHAR)
        else:
            mapped = word.encode("utf-8", "replace").decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _starts_in_word(self, word: str) -> tuple[int, ...]:
        if word.isascii():
            return tuple(accumulate((len(t.value) for t in self.tokenize(word.translate(BYTE_CHARS))), initial=0))[:-1]
        return tuple(a for a, _ in self.tokenizer.encode(word, add_special_tokens=False).offsets)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _whole_starts(self, text: str) -> bytes:
        return np.array([a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets], "<u4").tobytes()

    def _piece_ids(self, piece: str, space: str = SPACE_CHAR) -> bytes:
        """Ids of a piece after a space or, with space="", of one at the start of a text or line."""
        if piece.isalpha():  # a word of its own
            mapped = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(BYTE_CHARS)
            return array("I", [t.id for t in self.tokenize(space + mapped)]).tobytes()
        if not piece or piece[-1].isspace() or space and piece[0].isspace():
            raise _Awkward
        own = self._ids if space else self._first_ids
        core, end = piece[:-1], piece[-1]
        if core.isalpha() and not end.isalnum():
            return own[core] + self._word_ids[end]
        if (core := piece.rstrip(punctuation)).isalpha():
            return own[core] + self._word_ids[piece[len(core) :]]
        first, *lines = piece.split("\n")
        if lines and first and not first[-1].isspace() and not any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            newline = self._word_ids["\n"]  # alone between two characters that aren't white space: a word of its own
            return own[first] + b"".join([newline + self._first_ids[x] for x in lines])
        return b"".join(map(self._word_ids.__getitem__, WORD.findall(" " + piece if space else piece)))

    def _piece_starts(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Awkward
        out, at = array("I"), 0
        for word in WORD.findall(" " + piece):
            out.extend([at + a for a in self._word_starts[word]])
            at += len(word)
        return out.tobytes()

    def _whole_only(self, text: str) -> bool:
        return any(map(text.__contains__, self.added))

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null or empty text."""
        if not text:
            return b""
        head, *rest = text.split(" ")
        if head and not head[-1].isspace() and not self._whole_only(text):
            try:
                return self._first_ids[head] + b"".join(map(self._ids.__getitem__, rest))
            except _Awkward:
                pass
        return self._whole(text)

    def starts(self, text: str | None) -> np.ndarray:
        """Character at which each token starts (that of its first byte's character)."""
        if not text:
            return np.zeros(0, np.int64)
        head, *rest = text.split(" ")
        if head and not head[-1].isspace() and not self._whole_only(text):
            try:
                parts = [self._whole_starts(head), *map(self._starts.__getitem__, rest)]
            except _Awkward:
                return np.frombuffer(self._whole_starts(text), "<u4").astype(np.int64)
            at = np.fromiter(accumulate((len(p) + 1 for p in rest), initial=len(head)), np.int64, len(rest) + 1)
            base = np.concatenate([[0], at[:-1]])
            counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            return np.frombuffer(b"".join(parts), "<u4") + np.repeat(base, counts)
        return np.frombuffer(self._whole_starts(text), "<u4").astype(np.int64)


def encoder(path: str, plain: bool = False) -> Encoder:
    """An encoder for one task: workers are reused by later stages, which shouldn't find its caches there."""
    return Encoder(path, plain)
