"""Encoding, shards, prefix tables and packing against the libraries and round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from plumbline.llm import packing, prefix_bpe, wavelet
from plumbline.llm.encoding import TextEncoder, vocabulary
from tests.llm.conftest import EDGE

ALPHABET = ["a", "b", "th", "the", " ", "  ", "\n", "\t", "\r\n", "é", "日本", "😀", "'", "'s", "'l", "l", "1", "!!", "\x1c", "\x85", "\xa0", " ", "　", "   ", "<|endoftext|>", "²"]


def scraps(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return prefix_bpe.prefix_encoder(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def ranked(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.merges.ranks, special_tokens={}).encode_ordinary


def test_chunked_encoding_equals_the_library(library):
    encoder = TextEncoder(vocabulary("byte_bpe_50k.json"), limit=200)  # forgets between batches
    for seed in range(20):
        texts = scraps(seed, 30)
        values, starts = encoder.encode(pa.array(texts))
        assert [values[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [library(t) for t in texts]


def test_wavelet_matrix_against_arrays():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (64, 5), (5_000, 50_000), (777, 1)):
        ids = rng.integers(0, top, n).astype("<u4")
        matrix = wavelet.Shard.from_bytes(wavelet.Shard([None, 4], np.array([0, n]), wavelet.WaveletMatrix.of(ids)).to_bytes()).matrix
        assert (matrix.to_array() == ids).all()
        at = rng.integers(0, max(n, 1), 50) if n else np.zeros(0, int)
        assert (matrix.access(at) == ids[at]).all()
        for token in (0, 1, top - 1, top + 70_000, *ids[:3].tolist()):
            places = np.flatnonzero(ids == token)
            lo, hi = n // 4, n // 2
            assert matrix.count(token) == len(places) and matrix.rank(token, hi) == (ids[:hi] == token).sum()
            assert (matrix.occurrences(token) == places).all()
            assert (matrix.occurrences(token, lo, hi) == places[(places >= lo) & (places < hi)]).all()
            assert matrix.select(token, len(places)) == -1
            assert all(matrix.select(token, k) == p for k, p in enumerate(places[:3]))


def test_shards_read_back_and_answer(edge, library):
    manifest = wavelet.write_shards(edge, shard_tokens=500).cache()
    rows = wavelet.read_documents(manifest).collect()
    want = sorted((-1 if i is None else i, t or "") for i, t in EDGE)
    got = sorted(rows, key=lambda r: r["start"])
    ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in got]
    assert [(-1 if r["doc_id"] is None else r["doc_id"], x) for r, x in zip(got, ids, strict=True)] == [(i, [*library(t), 2]) for i, t in want]
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    whole = np.concatenate(ids)
    some = [2, int(whole[0]), 49_999]
    counts = {r["token"]: r["n"] for r in wavelet.count_tokens(manifest, some).collect()}
    assert counts == {t: int((whole == t).sum()) for t in some}
    assert sorted(r["place"] for r in wavelet.find_token(manifest, some[1]).collect()) == np.flatnonzero(whole == some[1]).tolist()


def test_broken_shard_is_refused():
    data = bytearray(wavelet.Shard([1], np.array([3]), wavelet.WaveletMatrix.of(np.array([1, 2, 3], "<u4"))).to_bytes())
    data[-1] ^= 1
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(bytes(data))


def test_prefix_encoding_equals_tiktoken(encoder, ranked):
    for text in [*scraps(3, 400), "x" * 5_000, "the" * 900]:
        values, _ = encoder.encode(pa.array([text]))
        assert values.tolist() == ranked(text)
        assert encoder.decode(values.tolist()) == text.encode()


def test_appends_are_exact(encoder, ranked):
    rng = random.Random(4)
    for text in scraps(4, 600):
        cut = rng.randrange(len(text) + 1)
        assert encoder.append(text[:cut], ranked(text[:cut]), text[cut:]) == ranked(text)


def test_near_edits_touch_little(encoder):
    rng = random.Random(5)
    for _ in range(60):
        piece = "".join(rng.choice("abtheinrs") for _ in range(rng.randrange(1, 600))).encode()
        start = rng.randrange(len(piece) + 1)
        end, new = min(len(piece), start + rng.randrange(9)), b"the"[: rng.randrange(4)]
        table = prefix_bpe.PrefixTable(encoder.merges, piece)
        table.replace(start, end, new)
        fresh = prefix_bpe.PrefixTable(encoder.merges, piece[:start] + new + piece[end:])
        assert (table.piece, table.last) == (fresh.piece, fresh.last)
    table = prefix_bpe.PrefixTable(encoder.merges, b"abcdefgh" * 500)
    assert table.replace(8, 9, b"z") < 400


def test_encode_decode_append_documents(edge, ranked):
    encoded = prefix_bpe.encode_documents(edge).cache()
    rows = prefix_bpe.decode_documents(encoded).collect()
    assert sorted((r["decoded"].decode(), r["ids"]) for r in rows) == sorted((t or "", ranked(t or "")) for _, t in EDGE)
    spark = edge.sparkSession
    tails = spark.createDataFrame([(1, "it'", ranked("it'"), "ll do"), (2, None, None, "x"), (3, "a ", ranked("a "), None)], "doc_id long, text string, ids array<int>, tail string")
    got = {r["doc_id"]: r["ids"] for r in prefix_bpe.append_documents(tails, "tail").collect()}
    assert got == {1: ranked("it'll do"), 2: ranked("x"), 3: ranked("a ")}


def check_pieces(pieces, expected, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert len(p["ids"]) == 4 * p["length"] > 0
    for some in by_sequence.values():
        some.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in some])
        assert [p["offset"] for p in some] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    used = sorted(np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist())
    assert used == sorted(x for ids in expected for x in ids)
    return by_doc, by_sequence


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_cover_every_document(edge, library, capacity):
    pieces = packing.pack_documents(edge, capacity=capacity).collect()
    expected = [[*library(t or ""), 1] for _, t in EDGE]
    by_doc, by_sequence = check_pieces(pieces, expected, capacity)
    lone = {i: ids for (i, _), ids in zip(EDGE, expected, strict=True) if i not in (None, 9)}
    for (doc_id, tokens), some in by_doc.items():
        if doc_id in lone:
            whole = np.array(lone[doc_id], "<u4")
            assert tokens == len(whole)
            assert all(zlib.crc32(p["ids"]) == zlib.crc32(whole[p["start"] : p["start"] + p["length"]].tobytes()) for p in some)
    lengths = [sum(p["length"] for p in some) for some in by_sequence.values()]
    assert all(n == capacity or n & (n - 1) == 0 for n in lengths)


def test_packing_balances_cost():
    lengths = np.array([1500, 1400, 700, 600, 500, 400, 300, 200, 100, 444] * 20)
    pieces, sequences = packing.pack(lengths, 2048, 1.0, 1 / 1024)
    assert pieces[:, 2].sum() == lengths.sum()
    filled = np.bincount(pieces[:, 3], weights=pieces[:, 2], minlength=sequences)
    cost = np.bincount(pieces[:, 3], weights=packing.attention_cost(pieces[:, 2]), minlength=sequences)[filled == 2048]
    assert cost.max() < 2.2 * cost.min()


def test_empty_tables(nothing):
    assert wavelet.read_documents(wavelet.write_shards(nothing)).collect() == []
    assert prefix_bpe.decode_documents(prefix_bpe.encode_documents(nothing)).collect() == []
    assert packing.pack_documents(nothing).collect() == []
