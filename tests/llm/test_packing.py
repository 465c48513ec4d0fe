import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from newsmood.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, size):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            assert r.length <= size and (k == 0 or r.length == size)
            at += r.length
        assert at == len(ids)
        assert len(ids) > size or len(pieces[i]) == 1
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return bins


def test_pieces_and_sequences(spark, make_docs):
    texts = [None, "", "one", "one"] + ["word " * n + "\n\n  x" for n in range(1, 400)] + ["the end " * 3_000]
    rows = packing.pack(make_docs(texts), PATH, public_tokenizers.PATTERN, size=256, group=100).collect()
    bins = check(rows, texts, 256)
    total = sum(r.length for r in rows)
    assert len(bins) <= total / 256 * 1.03 + len(rows) / 100 + 1  # a group costs about one sequence
    assert packing.pack(make_docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_special_tokens_as_the_file_has_them(spark, make_docs):
    own, memo = Tokenizer.from_file(PATH), packing.word_ids(PATH, public_tokenizers.PATTERN)
    rng = np.random.default_rng(6)
    parts = ["a", "bc", " ", "\n", "é", "1", "'s", "\t", "<|endoftext|>", "<|endoftext|", "<|"]
    texts = ["", "a b", "<|endoftext|>"] + ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(1_000)]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in memo.special_batch(pa.array(texts))] == want
    assert sum(50256 in ids for ids in want) > 300
    rows = packing.pack(make_docs(texts), PATH, public_tokenizers.PATTERN).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in rows} == {
        (i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, ids in enumerate(want)}


def test_sum_of_squares_against_definition():
    """Each piece goes where the sum of squares, counted anew, is smallest."""
    rng = np.random.default_rng(1)
    size, lengths = 20, rng.integers(1, 21, 200)
    where, offset = packing.sum_of_squares(lengths, size)
    gaps = []
    for s, b, at in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        def total(chosen):
            after = gaps.copy()
            after[chosen] -= s
            counts = np.bincount([g for g in after if g], minlength=size + 1)
            return int((counts ** 2).sum())

        fitting = [k for k, g in enumerate(gaps) if g >= s]
        if fitting:
            assert total(b) == min(map(total, fitting))
        else:
            assert b == len(gaps)
            gaps.append(size)
        assert at == size - gaps[b]
        gaps[b] -= s
    assert min(gaps) >= 0


def test_word_memo_is_the_tokenizer():
    own, memo = Tokenizer.from_file(PATH), packing.word_ids(PATH, public_tokenizers.PATTERN)
    own.encode_special_tokens = True
    rng = np.random.default_rng(5)
    parts = ["a", "bc", " ", "\n", "é", "1", "'s", "!", "\t", "\xa0", "<|endoftext|>", "中"]
    for _ in range(2_000):
        text = "".join(rng.choice(parts, rng.integers(0, 20)))
        assert memo.packed(text) == packing.packed_ids(own.encode(text, add_special_tokens=False).ids), repr(text)
