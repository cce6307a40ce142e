"""Token files, byte-pair coding, separator scan and packing against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frostline.llm import bpe, catalog, packing, pfor, separator_scan, tokens
from frostline.llm.tokens import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
EDGES = [
    None, "", " ", "\n\n", "a", "It's a dog's life, we'll see!!'s", "x" * 3000, "naïve Ünïcode été " * 40, "日本語のテキスト 한국어", "  two  spaces   and 　 wide ",
    "<|endoftext|> inside <|startoftext|>", "tabs\tand\r\nlines", "1234 5,678.90 %%% ###", "🙂👩‍👩‍👧 é", "same text", "same text",
]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def pieces(seed, n):
    rng = random.Random(seed)
    parts = [*"ab'sStT éèñ 　\u0085  \n\t\r\x1c!?\"日한🙂́‍0123$%#|<>", "<|endoftext|>", "'ll", "  ", "the ", " of", "�", "<|", "|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(n)]


def test_piecewise_encoding_equals_the_library(word):
    ours = PieceEncoder(WORD)
    for text in pieces(1, 4000) + [t or "" for t in EDGES]:
        assert list(np.frombuffer(ours.encode_all([text])[0], "<u4")) == word.encode(text, add_special_tokens=False).ids, text


class Counted:
    """Stands for the library's object and counts what one of its methods is given."""

    def __init__(self, real, method):
        self.given = []
        self.call = getattr(real, method)
        setattr(self, method, self.count)

    def count(self, what, **options):
        self.given += what if isinstance(what, list) else [what]
        return self.call(what, **options)


def test_words_with_any_punctuation_behind_do_not_need_the_whole_tokenizer(word):
    ours, words = PieceEncoder(WORD), [f"{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "klmn"]
    ours.tokenizer = Counted(ours.tokenizer, "encode_batch_fast")
    for end in ("###", "!!", ".%%%", "'\"", "_", "<|", "\\]"):
        text = " ".join(w + end for w in words)
        assert list(np.frombuffer(ours.encode_all([text])[0], "<u4")) == word.encode(text, add_special_tokens=False).ids, end
    assert not ours.tokenizer.given


def test_frequent_words_stay_while_rare_ones_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 40)
    monkeypatch.setattr(tokens, "MAX_PIECES", 40)
    ours, letters = PieceEncoder(WORD), "abcdefghij"
    ours.words.model = Counted(ours.words.model, "tokenize")
    for i in range(100):
        ours.encode_all([" ".join(["always", *(f"q{letters[i // 10]}{letters[i % 10]}{c}" for c in letters)])])
    assert ours.words.model.given.count("always") == 1
    assert len(ours.words.known) <= 40


def test_rows_of_a_batch_are_cut_by_bytes(word, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 50)
    texts = ["", "x" * 300, *(t for t in pieces(5, 200)), "", "the\nend of it.", ""]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = list(PieceEncoder(WORD).rows(batch.slice(1)))
    assert [i for i, _ in got] == list(range(1, len(texts)))
    for i, ids in got:
        assert list(np.frombuffer(ids, "<u4")) == word.encode(texts[i], add_special_tokens=False).ids, texts[i]
    assert list(PieceEncoder(WORD).rows(batch.slice(0, 0))) == []


def test_piecewise_encoding_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        PieceEncoder(BYTE)


def test_forced_boundaries_equal_the_library(byte):
    ours = bpe.ForcedBoundaryCoder(BYTE)
    for text in pieces(2, 4000) + [t or "" for t in EDGES]:
        ids = byte.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(ours.encode(text), "<u4")
        assert list(got) == ids, text
        assert ours.decode(got) == byte.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        bpe.ForcedBoundaryCoder(WORD)


def test_boundaries_are_between_bytes_of_no_token():
    ours = bpe.ForcedBoundaryCoder(BYTE)
    first, second = np.divmod(np.nonzero(ours.cut)[0], 256)
    forbidden = set(zip(first.tolist(), second.tolist()))
    assert forbidden
    for token in ours.token_bytes[:-1]:
        assert not forbidden.intersection(zip(token, token[1:]))
    assert len(ours.pieces(b"The cat, the dog")) > 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=600), st.integers(0, 600), st.integers(0, 600))
def test_segments_give_back_ids_and_ranges(values, lo, hi):
    ids = np.array(values, np.uint32)
    stored = pfor.pack(ids)
    assert (pfor.unpack(stored) == ids).all()
    assert list(pfor.unpack(stored, lo, hi)) == values[lo:hi]


def test_outliers_go_to_exception_lists():
    ids = np.arange(128, dtype=np.uint32) % 16
    wide = ids.copy()
    wide[7] = 2**31
    assert len(pfor.pack(wide)) == len(pfor.pack(ids)) + 5  # a position and the high bits
    with pytest.raises(ValueError):
        pfor.unpack(b"none" + bytes(20))


def expected(word, rows, end):
    return {i: word.encode(t or "", add_special_tokens=False).ids + [end] for i, t in rows}


def test_token_files(make_docs, run_of, word):
    rows = [(7 * k % 101, t) for k, t in enumerate(EDGES)]
    segments = pfor.write_ids(make_docs(rows, extra=True), run_of("pfor"), WORD, 1)
    got = pfor.with_start(pfor.read_ids(segments), segments).collect()
    want, start = expected(word, rows, 1), 0
    by_id = {r["doc_id"]: r for r in got}
    for i in sorted(want):
        assert by_id[i]["start"] == start
        assert list(np.frombuffer(bytes(by_id[i]["ids"]), "<u4")) == want[i]
        start += len(want[i])


def test_token_files_of_repeated_null_and_no_rows(make_docs, run_of):
    segments = pfor.write_ids(make_docs([(None, "b"), (3, "a"), (3, "a"), (3, None)]), run_of("pfor"), WORD, 1)
    got = pfor.with_start(pfor.read_ids(segments), segments).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 3, 3, 3]
    assert sorted(r["start"] for r in got) == list(np.cumsum([0] + [len(r["ids"]) // 4 for r in got])[:-1])
    none = pfor.write_ids(make_docs([]), run_of("pfor"), WORD, 1)
    assert pfor.with_start(pfor.read_ids(none), none).count() == 0


def test_encode_and_decode_columns(make_docs, byte):
    rows = list(enumerate(EDGES))
    coded = bpe.encode(make_docs(rows, extra=True), BYTE)
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded, BYTE).collect()}
    for i, t in rows:
        assert ids[i] == byte.encode(t or "", add_special_tokens=False).ids
        assert back[i] == (t or "")
    assert bpe.round_trip(make_docs([]), BYTE).count() == 0


def test_separator_scan_over_block_edges(make_docs, run_of, word):
    rows = list(enumerate(EDGES))
    for block_ids in (3, 64, 1 << 15):
        run = run_of("scan")
        blocks, order = separator_scan.write_flat(make_docs(rows, extra=True).repartition(3), run, WORD, 49407, block_ids)
        got = separator_scan.document_counts(blocks, run, 49407).join(order, ["file", "document"]).collect()
        ours = Tokenizer.from_file(WORD)
        ours.encode_special_tokens = True
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(ours.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
        for file in {r["file"] for r in got}:
            at = 0
            for r in sorted((r for r in got if r["file"] == file), key=lambda r: r["document"]):
                assert r["start"] == at
                at += r["n_tokens"]


def test_separator_scan_of_plain_files(spark, run_of, tmp_path):
    ids = np.array([5, 9, 6, 9, 9, 4, 4], "<u4")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = separator_scan.blocks_of_files(spark, str(tmp_path), 2)
    got = separator_scan.document_counts(blocks, run_of("scan"), 9).orderBy("document").collect()
    assert [(r["document"], r["start"], r["n_tokens"]) for r in got] == [(0, 0, 2), (1, 2, 2), (2, 4, 1), (3, 5, 2)]  # the last was never closed


def check_sequences(rows, capacity):
    seen = {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seen)


def test_packing_by_tree(make_docs, run_of, word):
    rng = random.Random(5)
    rows = [(i, "word " * rng.choice([1, 3, 5, 30, 31, 32, 60, 200])) for i in range(600)] + [(1000 + i, t) for i, t in enumerate(EDGES)]
    got = packing.pack(make_docs(rows, extra=True).repartition(7), run_of("pack"), WORD, 1, capacity=64, node_items=20, keep_ids=True)
    found = got.collect()
    want = expected(word, rows, 1)
    by_doc = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == 64 * r["piece"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        by_doc.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    assert by_doc == want
    bins = check_sequences(found, 64)
    assert bins <= 1.03 * sum(map(len, want.values())) / 64 + 2
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(got).collect()}
    assert sum(whole.values()) == sum(map(len, want.values()))


def test_packing_what_cannot_be_joined_and_nothing(make_docs, run_of):
    rows = [(i, "word " * 40) for i in range(50)]
    assert check_sequences(packing.pack(make_docs(rows).repartition(5), run_of("pack"), WORD, 1, capacity=64, node_items=8).collect(), 64) == 50
    assert packing.pack(make_docs([]), run_of("pack"), WORD, 1).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_never_overfills(sizes):
    where, offset, fill = packing.best_fit(np.array(sizes, np.int64), 20)
    assert all(f <= 20 for f in fill) and sum(fill) == sum(sizes)
    for b in range(len(fill)):
        spans = sorted((o, s) for w, o, s in zip(where, offset, sizes) if w == b)
        assert [o for o, _ in spans] == list(np.cumsum([0] + [s for _, s in spans])[:-1])


def test_registered_queries(spark, sf_dir, word, byte):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want, start = expected(word, docs.items(), 1), 0
    op2 = {r["doc_id"]: r for r in catalog.QUERIES["op2_patched_frame_of_reference"](spark, sf_dir).collect()}
    for i in sorted(docs):
        raw = np.array(want[i], "<u4").tobytes()
        assert (op2[i]["start"], op2[i]["n_tokens"], op2[i]["ids_crc32"]) == (start, len(want[i]), zlib.crc32(raw))
        start += len(want[i])
    for r in catalog.QUERIES["op4_forced_boundary_bpe"](spark, sf_dir).collect():
        ids = byte.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    op5 = {r["doc_id"]: r["n_tokens"] for r in catalog.QUERIES["op5_separator_scan"](spark, sf_dir).collect()}
    assert op5 == {i: len(x) for i, x in want.items()}
    op8 = catalog.QUERIES["op8_hierarchical_packing"](spark, sf_dir).collect()
    assert check_sequences(op8, 4096) <= sum(map(len, want.values())) / 4096 * 1.02 + 1
