"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Every byte maps to one printable character, so that the merges work on characters: printable Latin-1 bytes stand for
themselves and the others for code points from 256 on. Decoding reverses that table. A token may end inside a
character; decode_pieces() holds such bytes back until the character is whole.

Defined cases: a null text counts as empty and has no ids; an empty table gives an empty table; repeated rows and null
row ids are encoded like any other row; further input columns are ignored. Texts are encoded whole. Strings that look
like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Chunks between spaces that a worker remembers with their ids: so many of the latest, and as many of those before them, in
#: about 90 MB. Of other pieces it remembers a sixteenth.
REMEMBERED = 1 << 18

ENCODED = "row_id long, ids binary, decoded binary"


def byte_table() -> list[str]:
    """The character of each byte: itself if it is printable and no space, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Known(dict):
    """Ids, as bytes, of strings met before; others are asked of find. Two generations: a full young one becomes the old one."""

    def __init__(self, find, room: int):
        super().__init__()
        self.find, self.room, self.old = find, room, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.find(text)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[text] = ids
        return ids


class _Uneven(Exception):
    """A space that stands next to other white space, or at an end."""


class ByteBpe:
    """A tokenizer from a rank file. pattern: splits a text into the pieces that are encoded separately."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        from tokenizers import Tokenizer, models

        self.ranks = load_ranks(path)
        self.chars = byte_table()
        self.bytes_of = {c: b for b, c in enumerate(self.chars)}
        self.find = regex.compile(pattern).findall
        spell = lambda token: "".join(map(self.chars.__getitem__, token))
        merges = [tuple(map(spell, pair)) for pair in map(self._halves, sorted(self.ranks, key=self.ranks.get)) if pair]
        vocabulary = {spell(token): rank for token, rank in self.ranks.items()}
        #: ignore_merges: a piece that is itself a token is that token, whatever merges would make of it.
        self.model = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        spelt_of = sorted((rank, bytes(map(self.bytes_of.__getitem__, spelt))) for spelt, rank in vocabulary.items())
        self.token_bytes = dict(spelt_of)
        #: All tokens' bytes end to end, and where each id's begin and how many they are; ids without a token have none.
        self.flat = np.frombuffer(b"".join(b for _, b in spelt_of), "u1")
        self.lengths = np.zeros(spelt_of[-1][0] + 1, "i8")
        self.lengths[[rank for rank, _ in spelt_of]] = [len(b) for _, b in spelt_of]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.tokenize = self.model.model.tokenize
        self.pieces = _Known(self._piece, REMEMBERED // 16)
        #: The public pattern takes a single space together with what follows, so texts fall apart before such spaces.
        self.chunks = _Known(self._chunk, REMEMBERED) if pattern == public_tokenizers.PATTERN else None

    def spell(self, piece: str) -> str:
        """A piece's bytes as characters of the byte table."""
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.chars[0x20])
        return "".join(map(self.chars.__getitem__, piece.encode()))

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one: what merges of lower rank leave of its bytes."""
        if len(token) < 2:
            return None
        rank, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(pairwise(parts)))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, from the tokenizers library."""
        return array("I", [t.id for t in self.tokenize(self.spell(piece))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a space and what follows it up to the next one."""
        if chunk.isalpha():
            return self._piece(" " + chunk)
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Uneven
        if chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]
        return self._pieces(" " + chunk)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if not rest or self.chunks is None or not first or first[-1].isspace():
            return self._pieces(text)
        try:
            return self._pieces(first) + b"".join(map(self.chunks.__getitem__, rest))
        except _Uneven:
            return self._pieces(text)

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()

    def offsets(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """For each id the characters that its bytes touch, end exclusive; neighbours share a character that they split."""
        raw = np.frombuffer(text.encode(), "u1")
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        return [(int(char_of[a]), int(char_of[b - 1]) + 1) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []

    def decode_pieces(self, ids: bytes) -> list[str]:
        """The text that each id completes; a character split over ids comes with the last of them."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        out = [held.decode(self.token_bytes[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        if out:
            out[-1] += held.decode(b"", final=True)
        return out


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    """One tokenizer for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """row_id, ids (little-endian unsigned 32-bit integers) and decoded (the bytes that these ids stand for) of each row.

    rank_file: a path that each executor can read; None: the multilingual file of the public_tokenizers package there.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_file or public_tokenizers.path(RANKS))
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())], names=["row_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def token_offsets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """row_id, ids (array of int) and the first and past-the-end character of each id."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_file or public_tokenizers.path(RANKS))
        kind = pa.list_(pa.int32())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [bpe.encode(t) for t in texts]
            spans = [bpe.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(i, "<i4") for i in ids], kind), pa.array([[a for a, _ in s] for s in spans], kind), pa.array([[b for _, b in s] for s in spans], kind)], names=["row_id", "ids", "starts", "ends"])

    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "row_id long, ids array<int>, starts array<int>, ends array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: digests of the ids and of the decoded bytes of every document."""
    from plumbline.llm.common import table

    return encode_decode(table(spark, sf_dir, "documents")).select(
        F.col("row_id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
