"""Sum-of-squares packing of documents into sequences of at most ``size`` tokens.

1. Every text is tokenised in its map task and cut into pieces: a document of more than ``size`` tokens into pieces of
   exactly ``size``, but the first, which may be shorter. Only (doc_id, piece, start, length, crc) goes on.
2. The pieces are stored, counted, and dealt by a hash to groups of about ``group`` pieces, so that a group fits a
   task whatever the size of the corpus. A group costs about one sequence more than one packing of everything would.
3. In a group pieces go, longest first, where the sum over all residual gaps of the squared count of open bins with
   that gap becomes smallest (Csirik et al., "On the sum-of-squares algorithm for bin packing"); a new bin is opened
   only where a piece fits no open one. The state is a count for each gap: ``size`` numbers, whatever the number of
   bins. Pieces of exactly ``size`` fill a bin of their own.

The string of a special token, such as ``<|endoftext|>``, is its one id, as for ``tokenizers`` with the file as loaded.
A text without ids still has its end token, so that every document has a piece. Null is an empty text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import id_and_text, map_batches, worker_cache
from newsmood.llm.pretokens import SLICE, WordMemo
from newsmood.llm.pretokens import pack as packed_ids
from newsmood.sources.shared import materialise

SIZE = 2048
GROUP = 16_384
MEMO_WORDS = 600_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

JOINED = 256  # unseen words that go to the tokenizer as one text


class TokenizerMemo(WordMemo):
    """Ids by ``tokenizers`` of a vocabulary file. The strings of special tokens are ordinary text, but in
    ``special_batch``, where each is the one id that the file gives it."""

    def __init__(self, path: str, pattern: str, most: int, slice_bytes: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task for each core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.line_break = self._ids("\n")[0]
        # the longest first, as one string may begin with another; the file's have no further conditions
        added = sorted((t.content, i) for i, t in self.own.get_added_tokens_decoder().items() if t.special)
        self.special = {text: np.array([i], "<u4") for text, i in added}
        self.special_re = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        super().__init__(pattern, self._encode, most, slice_bytes)

    def _ids(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def special_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as the vocabulary file is loaded: texts are split at the strings of special tokens."""
        held = pa.array(np.zeros(len(texts), bool))
        for text in self.special:
            held = pc.or_(held, pc.match_substring(texts, text))
        at, low = np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist(), 0
        for i in [*at, len(texts)]:
            yield from self.batch(texts[low:i])
            if i < len(texts):
                parts = re.split(f"({self.special_re})", texts[i].as_py())
                plain = self.batch(pa.array(parts[::2], pa.string()))
                yield np.concatenate([ids for p, found in zip([*parts[1::2], None], plain, strict=True)
                                      for ids in (found, *([] if p is None else [self.special[p]]))])
            low = i + 1

    def _encode(self, matches: list[str]) -> list[bytes]:
        """Several matches that begin with a space make one text, a line each, which is cut at the line breaks.

        A line break before a space is a match of its own, so it stands for itself and changes no other's ids.
        """
        out: dict[str, bytes] = {}
        lines = [m for m in matches if m[:1] == " " and len(m) > 1 and "\n" not in m]
        for at in range(0, len(lines), JOINED):
            some = lines[at:at + JOINED]
            found = np.asarray(self._ids("\n".join(some) + "\n"), "<u4")
            ends, ids = np.flatnonzero(found == self.line_break).tolist(), found.tobytes()
            for m, a, b in zip(some, [0, *[e + 1 for e in ends]], ends, strict=False):
                out[m] = ids[4 * a:4 * b]
        return [out[m] if m in out else packed_ids(self._ids(m)) for m in matches]


def word_ids(path: str, pattern: str, most: int = MEMO_WORDS, slice_bytes: int = SLICE) -> TokenizerMemo:
    """One memo for each Python worker; workers serve many tasks."""
    return worker_cache(("tokenizer", path, pattern, most, slice_bytes),
                        lambda: TokenizerMemo(path, pattern, most, slice_bytes))


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    def make():
        memo, end = word_ids(path, pattern), packed_ids([end_id])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), memo.special_batch(batch.column(1)), strict=True):
                for k, (at, n) in enumerate(cut(len(ids) + 1, size)):
                    crc = zlib.crc32(ids[at:at + n])
                    rows.append((doc_id, k, at, n, zlib.crc32(end, crc) if at + n > len(ids) else crc))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

        return each

    return map_batches(id_and_text(docs), make, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, placed in the order given; bins count from 0.

    A piece of length s that goes into a bin of gap g changes the sum of squares by 2 (n[g - s] - n[g]) + 2, or by
    1 - 2 n[s] if it fills the bin, as full bins are not counted.
    """
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # bins by gap
    count, never = np.zeros(size + 1, np.int64), np.iinfo(np.int64).max
    used, where, offset = 0, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]  # open bins of gap s, s + 1, ...
        change = 2 * (count[:size + 1 - s] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = never
        best = int(change.argmin())
        if change[best] == never:
            gap, bin_id, used = size, used, used + 1
        else:
            gap = s + best
            bin_id = open_bins[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = bin_id, size - gap
        if gap > s:
            open_bins[gap - s].append(bin_id)
            count[gap - s] += 1
    return where, offset


def pack_pieces(cut_pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut_pieces`` should be a stored table: it is read twice."""
    groups = max(1, -(-cut_pieces.count() // group))

    def place(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        where, offset = sum_of_squares(batch.column("length").to_numpy(), size)
        ids = (batch.column("grp").to_numpy().astype(np.int64) << 32) + where
        return (batch.drop_columns("grp").append_column("sequence_id", pa.array(ids))
                .append_column("offset", pa.array(offset)))

    dealt = cut_pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("grp").applyInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 0, size: int = SIZE,
         group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialise(pieces(docs, path, pattern, end_id, size), "pieces"), size, group)
