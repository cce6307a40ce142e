"""Token ids of whole texts with a tokenizer file, encoded once per distinct piece.

A vocabulary whose pre-tokenizer drops white space never forms a token across a space or a
line feed, so a text's ids are those of its pieces between them, one after the other. Some megabytes
of texts are cut at once and their distinct pieces found. A piece that is one plain word, with or without
ASCII punctuation behind, goes to the library's model, word and punctuation apart; any other
goes through the whole tokenizer. Each worker keeps the ids of words and other pieces it has met lately.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_WORDS = 300_000    # plain words a worker remembers
MAX_PIECES = 100_000   # other pieces likewise
CHUNK_BYTES = 8 << 20  # text cut into pieces at once
# Letters that normalisation leaves alone; the word pattern keeps them together and apart from punctuation.
PLAIN = "^(?P<word> ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<end>[!-/:-@\\[-`{-~]*)$"
_ENCODERS: dict = {}


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Recent(dict):
    """What ``find`` gives for each key, at most ``limit`` of them: whenever half as many have come in, those
    that were not asked for meanwhile are forgotten. Frequent keys stay."""

    def __init__(self, find: Callable[[str], bytes], limit: int):
        super().__init__()
        self.find, self.half, self.older = find, limit // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def looked_up(known: Recent, keys: pa.Array) -> pa.Array:
    """The value of each key, null for null; a distinct key is asked for once."""
    keys = keys.dictionary_encode()
    values = list(map(known.__getitem__, keys.dictionary.to_pylist()))
    return pa.array(values, pa.large_binary()).take(keys.indices)


class PlainWords:
    """Ids of pieces that are one plain word, from the tokenizer's model alone."""

    def __init__(self, tokenizer, lower: bool):
        self.model, self.lower, self.letters = tokenizer.model, lower, byte_letters()
        self.plain = re.compile(PLAIN)
        self.known = Recent(self._word, MAX_WORDS)
        self.ends = Recent(lambda m: np.asarray(tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes(), 1_000)
        self.coded = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    def ids(self, piece: str) -> bytes | None:
        """None if the piece is of another kind."""
        found = self.plain.fullmatch(piece)
        if not found:
            return None
        word, end = found.groups()
        return self.known[word.lower() if self.lower else word] + self.ends[end]

    def column(self, pieces: pa.Array) -> pa.Array:
        """The ids of many pieces; null for those of another kind."""
        found = pc.extract_regex(pieces, PLAIN)
        word, end = pc.struct_field(found, 0), pc.struct_field(found, 1)
        return pc.binary_join_element_wise(
            looked_up(self.known, pc.utf8_lower(word) if self.lower else word), looked_up(self.ends, end), pa.scalar(b"", pa.large_binary()))

    def _word(self, word: str) -> bytes:
        seen = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.coded[t.id] for t in self.model.tokenize(seen)])


class PieceEncoder:
    """``encode_all(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, literal_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = literal_specials
        self.known = Recent(self._ids, MAX_PIECES)
        whole = self._ids("One, two\n three's  \u00c9t\u00e94")
        if whole != b"".join(map(self._ids, ["One,", "two", "three's", "\u00c9t\u00e94"])):
            raise ValueError("this tokenizer keeps white space: its texts cannot be cut there")
        self.words = PlainWords(self.tokenizer, lower=self._ids("ABC") == self._ids("abc"))

    def _ids(self, piece: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _column(self, texts: pa.Array) -> list[bytes]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        plain = self.words.column(pieces.dictionary)
        others = pc.if_else(plain.is_null(), pieces.dictionary, None)
        ids = pc.coalesce(plain, looked_up(self.known, others)).take(pieces.indices)
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(at, at[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self._column(pa.array(texts, pa.large_string())) if texts else []

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """The first value of each row of an Arrow batch with the ids of the second, a text."""
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(size // CHUNK_BYTES)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield from zip(batch.column(0).slice(a, b - a).to_pylist(), self._column(batch.column(1).slice(a, b - a).cast(pa.large_string())))


def encoder(path: str, literal_specials: bool = False) -> PieceEncoder:
    """The worker's encoder for this file, kept between tasks."""
    key = (path, literal_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, literal_specials)
    return _ENCODERS[key]


def forget() -> None:
    """Give back what this worker's encoders hold, once a later step has no use for it."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
