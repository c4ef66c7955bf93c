"""Exact byte-level BPE ids with words encoded once in each Python worker.

A position between a character that is not white space and a blank is a word
boundary of the tokenizer's pattern whatever stands around it, as no alternative of
the pattern goes from the one to the other.  So a text split there has the ids of
its parts in a row, and a part met before needs no new encoding.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

WORDS_KEPT = 900_000
LONGEST_KEPT = 48
#: White space in any of the definitions of the libraries involved.
_ODD = set(map(chr, [0x85, 0xA0, 0x1680, 0x180E, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
                     *range(0x0B, 0x0D), *range(0x1C, 0x20), *range(0x2000, 0x200C)]))
_SPACE = _ODD | set(" \t\n\r")
#: Characters on which the libraries' tables can't differ: ASCII and Latin letters.
_PLAIN = re.compile(r"[\t\n\r!-~¡-ɏ]+").fullmatch


def packed(ids: list[int]) -> bytes:
    return (array("I", ids) if array("I").itemsize == 4 and sys.byteorder == "little" else np.array(ids, "<u4")).tobytes()


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes the 256 bytes: visible
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as packed 4-byte
    little-endian numbers.

    The file's merges are also given to a second implementation of BPE, which is
    faster on short words; it is used for Latin letters, digits and signs only, and
    only if ids follow the order of merges (as they then must agree).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary, letters = told["model"]["vocab"], byte_letters()
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.table = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            if token not in self.special:
                self.table[i] = bytes(map(letters.__getitem__, token))
        for token, i in self.special.items():
            self.table[i] = token.encode()
        self.words: dict[str, bytes | None] = {}
        self.quick = self._second(told["model"], vocabulary)

    def _second(self, model: dict, vocabulary: dict[str, int]):
        first = len(vocabulary) - len(model["merges"])
        joined = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])
        if any(vocabulary.get(token) != first + n for n, token in enumerate(joined)):
            return None
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {self.table[i]: i for token, i in vocabulary.items() if token not in self.special}
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _library(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes | None:
        """Ids of a blank and ``word``; None if the text can't be split beside it."""
        if not word or word[-1] in _SPACE:
            return None
        if self.quick and _PLAIN(word):
            ids = packed(self.quick(" " + word))
        else:
            ids = self._library(" " + word)
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.special):
            return self._library(text)
        first, *rest = text.split(" ")
        ids = list(map(self.words.get, rest))
        if None in ids:
            for n, x in enumerate(ids):
                if x is None:
                    x = ids[n] = self._word(rest[n])
                    if x is None:
                        return self._library(text)
        if first:
            if first[-1] in _SPACE:
                return self._library(text)
            ids.insert(0, packed(self.quick(first)) if self.quick and _PLAIN(first) else self._library(first))
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ``ids`` stand for, special tokens included."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker; Spark uses workers again, so the
    words that it has met serve later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
