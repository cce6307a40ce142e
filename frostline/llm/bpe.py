"""Byte-level BPE by forced boundaries, and its decoding.

If two bytes never stand side by side inside any vocabulary token, no token can cover both,
so every text can be cut between them before it is encoded: the pieces are encoded on their
own and the ids concatenated. Three more conditions keep the tokenizer's own word pattern
indifferent to the cut: it falls between characters, not after white space (a run of white space
looks ahead) and not before an apostrophe (which may open a contraction). Strings of special tokens
are set apart first, as the tokenizer itself does. Distinct pieces are encoded once per worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frostline.llm.shared import texts
from frostline.llm.tokens import MAX_PIECES, PlainWords, byte_letters

BATCH_PIECES = 4_096
MARK = 0xFF              # a byte that UTF-8 never uses
_CODERS: dict = {}


class ForcedBoundaryCoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("forced boundaries need a byte-level tokenizer without normalizer and prefix space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = {c: b for b, c in byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {k.encode(): np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.split = re.compile(b"(" + b"|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        vocabulary = spec["model"]["vocab"]
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        inside = np.zeros(65536, bool)
        for token, i in vocabulary.items():
            if token not in special:
                raw = bytes(letters[c] for c in token)
                self.token_bytes[i] = raw
                a = np.frombuffer(raw, np.uint8).astype(np.int64)
                inside[a[:-1] * 256 + a[1:]] = True
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.cut = ~inside & self._safe_pairs()
        self.known: dict[bytes, bytes] = {b"": b""}
        self.words = PlainWords(self.tokenizer, lower=False)

    @staticmethod
    def _safe_pairs() -> np.ndarray:
        """Pairs whose bytes alone show that the word pattern does not look across."""
        first, second = np.divmod(np.arange(65536), 256)
        space = (first == 32) | ((first >= 9) & (first <= 13)) | ((first >= 28) & (first <= 31))
        return ~space & (second != ord("'")) & ((second < 0x80) | (second >= 0xC0))

    def pieces(self, raw: bytes) -> list[bytes]:
        """The text cut at every forced boundary."""
        a = np.frombuffer(raw, np.uint8)
        if len(a) < 2:
            return [raw]
        cut = self.cut[a[:-1].astype(np.int32) * 256 + a[1:]]
        if (a >= 0x80).any():
            # white space outside ASCII: U+0085, U+00A0 (lead C2), U+1680, U+2000.., U+3000 (leads E1 to E3)
            cut[1:] &= a[:-2] != 0xC2
            cut[2:] &= ~((a[:-3] >= 0xE1) & (a[:-3] <= 0xE3) & (a[1:-2] >= 0x80) & (a[2:-1] >= 0x80)) if len(a) > 3 else True
        at = np.nonzero(cut)[0]
        return np.insert(a, at + 1, MARK).tobytes().split(b"\xff")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit bytes."""
        raw = text.encode()
        if self.split and self.split.search(raw):
            return b"".join(self.special.get(part) or self._encode(part) for part in self.split.split(raw))
        return self._encode(raw)

    def _encode(self, raw: bytes) -> bytes:
        pieces = self.pieces(raw)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            if len(self.known) > MAX_PIECES:
                self.known = {b"": b""}
            others = []
            for piece in set(pieces).difference(self.known):
                coded = self.words.ids(piece.decode())
                if coded is None:
                    others.append(piece)
                else:
                    self.known[piece] = coded
            for i in range(0, len(others), BATCH_PIECES):
                part = others[i:i + BATCH_PIECES]
                found = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
                self.known.update(zip(part, (np.asarray(e.ids, "<u4").tobytes() for e in found)))
            return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def coder(path: str) -> ForcedBoundaryCoder:
    if path not in _CODERS:
        _CODERS[path] = ForcedBoundaryCoder(path)
    return _CODERS[path]


IDS = pa.list_(pa.int32())


def id_lists(coded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of every whole text; null text as empty, repeated rows each on their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [coder(tokenizer).encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(coded)], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); special tokens are kept, null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [coder(tokenizer).decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` of each text in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = coder(tokenizer)
            coded = [code.encode(t) for t in batch.column(1).to_pylist()]
            back = [code.decode(np.frombuffer(x, "<u4")) for x in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), id_lists(coded), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
