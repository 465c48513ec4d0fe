"""Token ids of whole texts by the ids of their distinct words.

A byte-level tokenizer splits a text by a pattern and encodes every match for itself, so equal matches have equal ids.
``WordMemo`` finds the distinct stretches between single spaces of a batch of texts, encodes each once, keeps its ids,
and puts the ids of the texts together with array operations. A stretch may stand for itself because no match of the
pattern holds a space after a character that is no white space, and what follows such a space does not change how the
stretch before it is split. Texts with two white spaces side by side, or with one at an end, are split by the pattern
as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

WORDS = 400_000  # entries that each table of a memo holds before it starts again: some 90 MB
KEPT_LENGTH = 64  # longer words and matches are hardly met again
STEP = 200_000  # words whose ids are put together at once
SLICE = 8 << 20  # bytes of text that are split into words together, if one text is not longer
SPACE = r"[\t-\r\x{85}\pZ]"  # the pattern's \s
UNEVEN = f"^{SPACE}|{SPACE}{SPACE}|{SPACE}$|^$"
#: A word as most are: Latin letters, which with the space before them are one match, and ASCII signs but the apostrophe
#: behind them, which are another.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class WordMemo:
    """``encode`` gives the packed ids of each of several matches of ``pattern``."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], most: int = WORDS,
                 slice_bytes: int = SLICE):
        self.split = regex.compile(pattern).findall
        self.encode, self.most, self.slice_bytes = encode, most, slice_bytes
        self.matches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _of_matches(self, matches: list[str]) -> list[bytes]:
        known = self.matches
        if len(known) > self.most:
            known.clear()
        new = list({m: None for m in matches if m not in known})
        own = dict(zip(new, self.encode(new), strict=True)) if new else {}
        known.update((m, ids) for m, ids in own.items() if len(m) <= KEPT_LENGTH)
        return [own[m] if m in own else known[m] for m in matches]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words that follow a space, which is theirs."""
        split = [self.split(f" {w}") for w in words]
        flat, out, at = self._of_matches([m for s in split for m in s]), [], 0
        for s in split:
            out.append(flat[at] if len(s) == 1 else b"".join(flat[at:at + len(s)]))
            at += len(s)
        return out

    def _known_words(self, words: list[str]) -> list[bytes]:
        if len(self.words) > self.most:
            self.words.clear()
        out = list(map(self.words.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        if new:
            for i, ids in zip(new, self._of_words([words[i] for i in new]), strict=True):
                out[i] = ids
                if len(words[i]) <= KEPT_LENGTH:
                    self.words[words[i]] = ids
        return out

    def packed(self, text: str) -> bytes:
        """The ids of one text, little-endian unsigned 32-bit integers."""
        return next(self.batch(pa.array([text], pa.string()))).tobytes()

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            before = int(sizes[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, before + self.slice_bytes, side="right")))
            yield from self._slice(texts[low:high].cast(pa.large_string()))
            low = high

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; the arrays are views of one."""
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        for i in np.flatnonzero(uneven).tolist():
            text = texts[i].as_py()
            out[i] = np.frombuffer(b"".join(self._of_matches(self.split(text))), "<u4")
        even = np.flatnonzero(~uneven)
        if not len(even):
            return out
        lists = pc.split_pattern(texts.take(pa.array(even)) if uneven.any() else texts, " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary
        # every distinct word is one or two entries of a table of ids; entry 0 is empty
        parts = pc.extract_regex(distinct, PLAIN)
        plain = parts.is_valid()
        core = parts.field("core").filter(plain).dictionary_encode()
        tail = parts.field("tail").filter(plain).dictionary_encode()
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        letters = pc.binary_join_element_wise(none, core.dictionary, space)  # a space before each
        table = [b"", *self._of_matches(letters.to_pylist())]
        head, rest = np.zeros((2, len(distinct)), np.int64)
        is_plain = np.ones(len(distinct), bool)
        is_plain[odd] = False
        head[is_plain] = core.indices.to_numpy() + 1
        rest[is_plain] = tail.indices.to_numpy() + len(table)
        table += self._of_matches(tail.dictionary.to_pylist())
        head[odd] = np.arange(len(odd)) + len(table)
        table += self._known_words(distinct.take(pa.array(odd)).to_pylist())
        # the first word of a text follows no space: it is an entry of its own
        first = bounds[:-1]
        opening = [b"".join(self._of_matches(self.split(w))) for w in distinct.take(pa.array(at[first])).to_pylist()]
        head = np.concatenate([head, np.arange(len(first)) + len(table)])
        rest = np.concatenate([rest, np.zeros(len(first), np.int64)])
        at = at.astype(np.int64)
        at[first] = len(distinct) + np.arange(len(first))
        table += opening
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        ids, start = np.frombuffer(b"".join(table), "<u4"), np.cumsum(size) - size
        ends = np.cumsum((size[head] + size[rest])[at])
        total = np.empty(int(ends[-1]), "<u4")
        for low in range(0, len(at), STEP):
            some = at[low:low + STEP]
            entries = np.stack([head[some], rest[some]], axis=1).ravel()
            n, begun, stop = size[entries], int(ends[low - 1]) if low else 0, int(ends[low + len(some) - 1])
            before = begun + np.cumsum(n) - n
            total[begun:stop] = ids[np.repeat(start[entries] - before, n) + np.arange(begun, stop)]
        cuts = np.concatenate([[0], ends])[bounds]
        for i, a, b in zip(even.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = total[a:b]
        return out


def pack(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()
