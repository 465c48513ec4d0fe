import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from newsmood.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


_OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH),
                         special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab ' \n\t\xa0s1é中!", max_size=60))
def test_ids_of_any_text(text):
    coder, memo = bpe._loaded(PATH, public_tokenizers.PATTERN)
    packed = memo.packed(text)
    assert np.frombuffer(packed, "<u4").tolist() == _OWN.encode_ordinary(text)
    assert coder.decode(np.frombuffer(packed, "<u4")) == text.encode()


def test_every_token_and_pairs_of_tokens():
    coder, _ = bpe._loaded(PATH, public_tokenizers.PATTERN)
    random.seed(2)
    for _ in range(3_000):
        data = b"".join(random.choices(coder.tokens, k=random.randint(1, 4)))
        assert coder.encode(data) == _OWN._core_bpe.encode_single_piece(data)


def test_small_vocabulary_against_plain_merging():
    """Merges that end in dead ends, where the longest match is wrong."""
    ranks = {bytes([i]): i for i in range(256)}
    for token in (b"ab", b"bc", b"cd", b"abc", b"bcd", b"aa", b"aab", b"cdc", b"abcd"):
        ranks[token] = len(ranks)

    def merged(data):
        parts = [bytes([b]) for b in data]
        while True:
            best = min((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:] + [b"\0" * 9])))
            if best[0] == 10**9:
                return [ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    coder = bpe.Backtracker(ranks)
    random.seed(4)
    for _ in range(3_000):
        data = bytes(random.choices(b"abcd", k=random.randint(1, 14)))
        assert coder.encode(data) == merged(data), data


def test_query_rows(spark, make_docs):
    texts = [None, "", "Hello  world\n\n x", "a" * 100_000, "<|endoftext|> é😀", "same", "same"]
    rows = bpe.digests(make_docs(texts), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = _OWN.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    coded = bpe.encode(make_docs(texts), PATH, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.data).decode() for r in bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digests(make_docs([]), PATH, public_tokenizers.PATTERN).count() == 0
