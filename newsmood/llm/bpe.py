"""Byte-level BPE: encoding in linear time by backtracking over longest matches, and decoding.

The bytes of a word are mapped to Latin-1, one character a byte, so that a pyahocorasick automaton over the vocabulary
finds every token that occurs in it in one pass. From the left the longest token is taken whose pair with the token
before it is compatible: the two, merged by the ranks on their own, must come out as exactly these two. Where no token
at a position is compatible the position is marked dead and the last token gives way to its next shorter prefix. A
sequence whose neighbours are all compatible is the sequence that the merges produce, so the result is exact, and as
each position is marked at most once, the time is linear. Compatibility of a pair is memoised.

Nulls and empty texts have no ids. Very long texts go through whole; rows that repeat are encoded for themselves.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsmood.llm.common import id_and_text, map_batches, worker_cache
from newsmood.llm.pretokens import WordMemo, pack

PAIRS = 1_000_000  # memoised pairs before the memo starts again


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Backtracker:
    """Encodes byte strings by ``ranks``: every single byte has a rank, ranks run from 0 without gaps."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = [len(t) for t in self.tokens]
        self.whole = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.found = ahocorasick.Automaton()
        for name, rank in self.whole.items():
            self.found.add_word(name, rank)
        self.found.make_automaton()
        self.shorter = [self._longest_prefix(t) for t in self.tokens]  # -1: none
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        self.memo: dict[tuple[int, int], bool] = {}
        for rank, token in enumerate(self.tokens):
            self.halves.append(self._split(rank, token))

    def _longest_prefix(self, token: bytes) -> int:
        name = token.decode("latin-1")
        return next((self.whole[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.whole), -1)

    def _split(self, rank: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes this one; the token itself, twice, if none does."""
        left, name = self.shorter[rank], token.decode("latin-1")
        while left >= 0:
            right = self.whole.get(name[self.size[left]:], rank)
            if left < rank and right < rank and self._compatible(left, right):
                self.merged[left, right] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank ends with just these two tokens.

        The merges are undone from the later one to the earlier one. On the way no pair across the border may have a
        merge that would have come before the one that is undone.
        """
        merged, halves, before = self.merged, self.halves, len(self.tokens)
        while True:
            if merged.get((left, right), before) < before:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    part = halves[left][1]
                    if part != left:
                        before, left = left, part
                        break
                    before = right + 1
                else:
                    part = halves[right][0]
                    if part != right:
                        before, right = right + 1, part
                        break
                    before = left
                undo_left = not undo_left
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        if len(self.memo) >= PAIRS:
            self.memo.clear()
        known = self.memo[left, right] = self._compatible(left, right)
        return known

    def encode(self, data: bytes) -> list[int]:
        name = data.decode("latin-1")
        if name in self.whole:  # a token is the result of its own merges
            return [self.whole[name]]
        n, size, shorter, memo, compatible = len(data), self.size, self.shorter, self.memo, self.compatible
        longest = [0] * n
        for end, rank in self.found.iter(name):
            longest[end + 1 - size[rank]] = rank  # ends come in order, so the last is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        longest.append(0)
        at, token, last = 0, longest[0], -1
        while at < n:
            while True:
                end = at + size[token]
                if not dead[end] and (last < 0 or (memo[last, token] if (last, token) in memo
                                                   else compatible(last, token))):
                    out.append(token)
                    at, last = end, token
                    token = longest[at]
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                break
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _loaded(path: str, pattern: str) -> tuple[Backtracker, WordMemo]:
    """One automaton and memo for each Python worker; workers serve many tasks."""
    def make() -> tuple[Backtracker, WordMemo]:
        bpe = Backtracker(read_ranks(path))
        return bpe, WordMemo(pattern, lambda words: [pack(bpe.encode(w.encode("utf-8", "replace"))) for w in words])

    return worker_cache(("bpe", path, pattern), make)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, little-endian unsigned 32-bit integers in a binary column."""
    def make():
        memo = _loaded(ranks_path, pattern)[1]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [x.tobytes() for x in memo.batch(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

        return each

    return map_batches(id_and_text(docs), make, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids stand for."""
    def make():
        bpe = _loaded(ranks_path, pattern)[0]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = [bpe.decode(np.frombuffer(ids, "<u4")) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())],
                                              ["doc_id", "ids", "data"])

        return each

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, ids binary, data binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text; per document the number of ids and the digests of ids and of decoded bytes."""
    def make():
        bpe, memo = _loaded(ranks_path, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, data_sha = [], [], []
            for ids in memo.batch(batch.column(1)):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                data_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(data_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return map_batches(id_and_text(docs), make,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
