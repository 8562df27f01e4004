"""Operators 1, 3, 4 and 5 against the tokenizer libraries."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evgraph.llm import bpe, packing, rans, token_counts, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

HARD = [
    "", " ", "a", "  a　　 b", "a\x1c b", "\0abc \0d", "<|endoftext|> x<|endoftext|>", "a" * 3001, "it's'll don't 'sx '' 's", "\n\n\n x\t\ty  z  ", "日本語 テキスト、です。𐥀𐥁 abcՠ՘x",
    " a \u0085 b", "a\nb \n c\n d\n", "🎉🎉👍🏽 ok‍", "'" * 500, "a1b2c3" * 9000 + " b" * 20000, "é è y z　 w", " " * 3000 + "x", "word " * 30_000,
    "a \0 b", " \0", "a \0b", "x \0", "\0", "a\n\0\nb", "one \x1f two",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def wanted(library):
    return [e.ids for e in library.encode_batch(HARD, add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, text, 7) for k, text in enumerate(HARD)] + [(None, "no id", 1), (100, None, None), (5, HARD[5], 2), (5, HARD[5], 2), (5, "another text", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def ids_by_text(library, rows):
    return {r.text: [i for i in library.encode(r.text or "", add_special_tokens=False).ids] for r in rows}


def test_unit_encoder(library, wanted):
    encoder = tokens.UnitEncoder(JSON)
    for _ in range(2):  # learned, then from the cache
        ids, count = encoder.encode(HARD)
        assert count.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_unit_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 4000)
    monkeypatch.setattr(tokens, "PART_CHARS", 300)
    encoder, random = tokens.UnitEncoder(JSON), np.random.default_rng(1)
    for _ in range(20):
        texts = [" ".join(["the", "of", *("".join(random.choice(list("abcdé"), 6)) for _ in range(30 + 30 * (k == 3))), "x\ny  z", "\0"[k % 3 :]]) for k in range(5)]
        ids, count = encoder.encode(texts)
        wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert count.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]
        # what a batch learns stays until the next one
        assert encoder._held() < 4000 + 60 * sum(len(t.split()) for t in texts)
    assert {"of", " of"} <= set(encoder.keys.to_pylist())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1.'\n\t é　\u0085\x1c\0日!s<|endoftext|>"), max_size=40))
def test_any_text(text):
    from tokenizers import Tokenizer

    if not hasattr(test_any_text, "all"):
        test_any_text.all = Tokenizer.from_file(JSON), tokens.UnitEncoder(JSON), token_counts.PieceCounter(JSON), bpe.RankCodec(RANKS, part_chars=5)
    library, encoder, counter, codec = test_any_text.all
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text])[0].tolist() == ids
    assert counter.count([text]).tolist() == [len(ids)]
    assert codec.encode(text) == codec.library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_counts(docs, library):
    rows = docs.collect()
    own = ids_by_text(library, rows)
    found = token_counts.token_counts(docs, JSON)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = Counter((r.doc_id, len((r.text or "").encode()), len(own[r.text]), len(own[r.text]) > 512) for r in rows)
    assert Counter(map(tuple, found.collect())) == wanted
    assert token_counts.token_counts(docs.limit(0), JSON).count() == 0


def test_merging_is_simultaneous():
    merger = token_counts.RankMerger({c: k for k, c in enumerate([*token_counts.byte_letters().values(), "aa", "aaaa", "ab"])}, [("a", "a"), ("aa", "aa"), ("a", "b")])
    assert merger.count([b"", b"a", b"aa", b"aaa", b"aaaa", b"aaaab", b"abab", b"xyz"]).tolist() == [0, 1, 1, 2, 1, 2, 2, 3]


def test_long_pieces(library, monkeypatch):
    """One by one as together, as the library counts, and a million letters in seconds."""
    counter, random = token_counts.PieceCounter(JSON), np.random.default_rng(3)
    texts = ["".join(random.choice(list(letters), 3000)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "a", "é日aB")] + ["a" * 4001, "the" * 900]
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == wanted
    merger = counter.merger
    short = [t.encode()[:500] for t in texts]
    assert [merger.count_long(p) for p in short] == merger.count(short).tolist()
    monkeypatch.setattr(token_counts, "LONG", 10**9)
    assert token_counts.PieceCounter(JSON).count(texts).tolist() == wanted
    began = time.time()
    letters = "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    assert merger.count_long(letters.encode()) == len(library.encode(letters, add_special_tokens=False).ids)
    assert time.time() - began < 60


def test_codec(docs):
    codec = bpe.RankCodec(RANKS)
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, RANKS).collect()}
    for row in docs.collect():
        text = row.text or ""
        ids = codec.encode(text)
        if len(text) < 2000:
            assert ids == codec.library.encode_ordinary(text)
        assert (row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) in found
    decoded = bpe.decode_ids(bpe.encode_documents(docs, RANKS), RANKS)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in decoded.collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert bpe.round_trip(docs.limit(0), RANKS).count() == 0


def test_parts_are_safe():
    codec = bpe.RankCodec(RANKS, part_chars=3)
    text = "don't stop12now,, 'tis  over\n\n x" * 50
    assert "".join(codec.parts(text)) == text and len(list(codec.parts(text))) > 100
    assert codec.encode(text) == codec.library.encode_ordinary(text)
    assert codec.encode(" " * 500_000 + "x") and codec.decode(codec.encode(" " * 500_000 + "x")) == b" " * 500_000 + b"x"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=300), st.integers(1, 5))
def test_rans_round_trip(ids, times):
    ids = np.array(ids * times, np.uint32)
    table = rans.FrequencyTable.of_ids(ids)
    again = rans.FrequencyTable.from_bytes(table.bytes)
    assert again.crc == table.crc
    assert (rans.decode_blocks(rans.encode_blocks(ids, table), again) == ids).all()


def test_rans_blocks_checkpoints_and_damage():
    random = np.random.default_rng(1)
    ids = np.minimum(random.geometric(0.001, 3 * rans.BLOCK_TOKENS + 777), 50_000).astype(np.uint32)
    table = rans.FrequencyTable.of_ids(ids)
    assert table.frequency.sum() == 1 << rans.SCALE_BITS and table.frequency.min() >= 1
    blocks = rans.encode_blocks(ids, table)
    assert len(blocks) == 4 and (rans.decode_blocks(blocks, table, at_once=2) == ids).all()
    entropy = -sum(n / len(ids) * np.log2(n / len(ids)) for n in np.bincount(ids) if n)
    assert 8 * sum(map(len, blocks)) / len(ids) < entropy * 1.03 + 0.2
    for start, stop in ((0, 10), (16_383, 16_386), (40_000, 65_536), (5, 5), (65_000, 99_999)):
        assert (rans.decode_range(blocks[1], table, start, stop) == ids[rans.BLOCK_TOKENS :][start : min(stop, rans.BLOCK_TOKENS)]).all()
    broken = bytearray(blocks[0])
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks([bytes(broken)], table)
    with pytest.raises(ValueError):
        rans.decode_blocks(blocks[:1], rans.FrequencyTable.of_ids(ids[:1000]))
    one = rans.FrequencyTable.of_ids(np.full(70_000, 9, np.uint32))
    assert (rans.decode_blocks(rans.encode_blocks(np.full(70_000, 9, np.uint32), one), one) == 9).all()


def test_id_files(docs, library, tmp_path):
    path = f"file://{tmp_path}/ids"
    rans.write_ids(docs, JSON, path)
    rows = docs.collect()
    own = ids_by_text(library, rows)
    found = sorted(rans.read_ids(docs.sparkSession, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((r.doc_id, (*own[r.text], 0)) for r in rows)
    digests = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.read_digests(docs.sparkSession, path).collect()}
    assert digests == {(r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in found}
    assert rans.encoded_digests(docs.limit(0), JSON).count() == 0


def check_packing(rows, found, own, room=1024):
    by_place = {}
    for r in found:
        by_place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_place.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    wanted = Counter()
    for r in rows:
        ids = [*own[r.text], 2]
        for k, (start, length) in enumerate(packing.cut(len(ids), room)):
            wanted[r.doc_id, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    return len(by_place)


def test_packing(docs, library):
    rows = docs.collect()
    own = ids_by_text(library, rows)
    found = packing.pack(docs, JSON).collect()
    n = check_packing(rows, found, own)
    assert n == -(-sum(r.length for r in found) // 1024)
    assert packing.pack(docs.limit(0), JSON).count() == 0


def test_cut():
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]
    assert packing.cut(1) == [(0, 1)] and packing.cut(0) == []


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    rows = packing.plan(histogram, 30)
    used, seen = {}, Counter()
    for length, first, n, sequence, offset in rows.tolist():
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            assert used.get(sequence + k, 0) == offset
            used[sequence + k] = offset + length
    assert seen == Counter(histogram) and all(v <= 30 for v in used.values())
    bins = []  # best fit, piece by piece
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [(b, k) for k, b in enumerate(bins) if b >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(30 - length)
    assert len(used) == len(bins)


def test_plan_does_not_grow_with_documents():
    small, large = (packing.plan({k: n * (1 + k % 7) for k in range(1, 1025)}) for n in (10, 10_000))
    assert len(large) < 2 * len(small) + 1000
