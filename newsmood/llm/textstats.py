"""Numbers about the form of a text, from one pass over its bytes and one over its words."""

from __future__ import annotations

from collections import Counter

import numpy as np

_KINDS = np.zeros((7, 256), bool)
LETTERS, UPPER, DIGITS, STOPS, LOUD, SYMBOLS, SPACE = range(7)
_BYTES = np.arange(256)
_KINDS[UPPER] = (_BYTES >= 65) & (_BYTES <= 90)
_KINDS[LETTERS] = _KINDS[UPPER] | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_KINDS[DIGITS] = (_BYTES >= 48) & (_BYTES <= 57)
_KINDS[STOPS] = np.isin(_BYTES, list(b".,;:'\"()-"))
_KINDS[LOUD] = np.isin(_BYTES, list(b"!?"))
_KINDS[SPACE] = np.isin(_BYTES, list(b" \t\n\r\x0b\x0c"))
_KINDS[SYMBOLS] = ~(_KINDS[LETTERS] | _KINDS[DIGITS] | _KINDS[STOPS] | _KINDS[LOUD] | _KINDS[SPACE])
_SIGN = ~(_KINDS[LETTERS] | _KINDS[DIGITS] | _KINDS[SPACE])

FORM = ["log_words", "word_length", "distinct", "commonest", "repeats", "upper", "digits", "stops", "loud", "symbols",
        "sign_runs", "letter_runs", "entropy", "distinct_lines", "line_words"]


def form(text: str) -> list[float]:
    """The numbers named in ``FORM``; all 0 for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FORM)
    n = len(words)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = _KINDS @ counts
    size = len(data)
    often = Counter(words)
    same = data[1:] == data[:-1]
    thrice = same[1:] & same[:-1]
    share = counts[counts > 0] / size
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(n)), (size - kinds[SPACE]) / n, len(often) / n, often.most_common(1)[0][1] / n,
        sum(map(str.__eq__, words, words[1:])) / n, kinds[UPPER] / max(1, kinds[LETTERS]), kinds[DIGITS] / size,
        kinds[STOPS] / size, kinds[LOUD] / size, kinds[SYMBOLS] / size,
        float((same & _SIGN[data[1:]]).sum()) / n, float((thrice & _KINDS[LETTERS][data[2:]]).sum()) / n,
        float(-(share * np.log2(share)).sum()), len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
    ]
