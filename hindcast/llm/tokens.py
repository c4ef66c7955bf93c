"""Operator 8, BPE encoding and decoding: chunks cut by a rolling hash are encoded
once however many documents share them, then the joins between chunks are encoded
again from text until both sides agree with the chunks' own ids.

The cuts depend on the bytes around them only, so a passage that many documents
hold falls into the same chunks in each, wherever it stands.  A chunk's ids are kept
under its bytes themselves (no hash can collide) in a table of bounded size in each
Python worker; the work needs no shuffle, as moving texts or ids would cost more
than encoding them.  Inside a chunk only the ids between its first and last
*certain* word boundary are used: at a boundary from a character that is not white
space to a blank or a line end, the tokenizer splits whatever follows or precedes.
What lies outside, from the last certain boundary of a chunk to the first of the
next, is the join.  It is encoded as one text; where a chunk has no certain boundary
the join grows over it into the next one, so its edges always agree.

Rows: null text counts as empty (no ids, empty decoded text); repeated rows and
equal texts get equal results; a null ``doc_id`` stays null; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.common import map_texts, texts
from hindcast.llm.encoder import Encoder, default_path, encoder
from hindcast.sources.tables import read_table

#: Mean chunk 2**11 bytes between cuts, none under 512 and none over 16 KiB.
CHUNK_BITS, CHUNK_LEAST, CHUNK_MOST = 11, 512, 16_384
CHUNKS_KEPT_BYTES = 64_000_000
WINDOW_STEPS = 5  # doublings: the hash covers 32 bytes
_CERTAIN = re.compile(r"(?<=[!-~])(?=[ \n])")

_GEAR = np.random.default_rng(8).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where chunks end (the last is the end of the text): at bytes whose rolling
    hash has ``CHUNK_BITS`` zeros, moved to the next start of a character."""
    if len(data) <= CHUNK_LEAST:
        return [len(data)] if data else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in range(WINDOW_STEPS):
        back = 1 << step
        h[back:] = h[back:] + (h[:-back] << np.uint32(back))
    found = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    ends, at = [], 0
    for x in [*found.tolist(), len(data)]:
        while x - at > CHUNK_MOST:
            ends.append(at := _start(data, at + CHUNK_MOST))
        if x - at >= CHUNK_LEAST and x < len(data):
            ends.append(at := _start(data, x))
    if at < len(data):
        ends.append(len(data))
    return ends


def _start(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class ChunkEncoder:
    """Encodes texts by chunks; ``met`` and ``reused`` count bytes."""

    def __init__(self, words: Encoder):
        self.words, self.chunks, self.size, self.met, self.reused = words, {}, 0, 0, 0

    def _chunk(self, data: bytes) -> tuple[str, bytes, str] | str:
        """(text before the first certain boundary, ids up to the last, text after);
        the text alone where there are not two of them."""
        self.met += len(data)
        if (known := self.chunks.get(data)) is not None:
            self.reused += len(data)
            return known
        text = data.decode("utf-8")
        first = _CERTAIN.search(text)
        last = max(text.rfind(" "), text.rfind("\n"))
        while first and last > first.start() and not "!" <= text[last - 1] <= "~":
            last = max(text.rfind(" ", 0, last), text.rfind("\n", 0, last))
        if not first or last <= first.start():
            made = text
        else:
            made = (text[:first.start()], self.words.encode(text[first.start():last]), text[last:])
        self.size += 2 * len(data)
        if self.size > CHUNKS_KEPT_BYTES:
            self.chunks.clear()
            self.size = 2 * len(data)
        self.chunks[data] = made
        return made

    def encode(self, text: str) -> bytes:
        data = text.encode("utf-8")
        if len(data) <= CHUNK_LEAST or any(token in text for token in self.words.special):
            return self.words.encode(text)
        out, join, at = [], [], 0
        for end in cuts(data):
            made = self._chunk(data[at:end])
            at = end
            if isinstance(made, str):
                join.append(made)
            else:
                before, ids, after = made
                out += [self.words.encode("".join([*join, before])), ids]
                join = [after]
        out.append(self.words.encode("".join(join)))
        return b"".join(out)


_CHUNKS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _CHUNKS:
        _CHUNKS[path] = ChunkEncoder(encoder(path))
    return _CHUNKS[path]


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are 4-byte little-endian numbers in a binary.
    With ``decoded`` also text, what the ids decode to, made in the same pass."""
    path = path or default_path()

    def make():
        one = chunk_encoder(path)

        def work(batch):
            ids = [one.encode(x) for x in batch.column("text").to_pylist()]
            made = {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            return made | ({"text": [_text(one.words, x) for x in ids]} if decoded else {})
        return work

    return map_texts(texts(docs), make, "doc_id long, n_tokens long, ids binary" + ", text string" * decoded)


def _text(words: Encoder, ids: bytes) -> str:
    return words.decode(ids).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for rows that ``encode`` gives, special tokens included; bytes
    that are no UTF-8 become U+FFFD, null ids a null text."""
    path = path or default_path()

    def make():
        one = encoder(path)

        def work(batch):
            ids = batch.column("ids").to_pylist()
            return {"doc_id": batch.column("doc_id"), "text": [None if x is None else _text(one, x) for x in ids]}
        return work

    return map_texts(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and the round trip of every document, as digests."""
    made = encode(read_table(spark, sf_dir, "documents"), decoded=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
