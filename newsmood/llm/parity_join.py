"""Jaccard join of documents on their 3-word shingles, by parity sketches.

A sketch of m bits of a set flips one bit, chosen by hash, for every element. The sketches of two sets differ in at most
as many bits as the sets differ in elements, and sets of sizes a and b that are linked differ in at most k = (a + b) / 19
(100 * intersection >= 90 * union).

1. Sizes are cut into bands so that linked sets lie in one band or in neighbours. All sets of a band use the layout of the
   band and of the next one up. A layout has k + 2 pieces of 64 bits, k for the largest sizes of its band.
2. Pigeonhole: of k + 2 pieces at most k differ, so linked sets agree in two pieces at least. A set is posted under each
   (layout, piece, bits) with ``low`` bits or more; pieces with fewer, which unlike sets also share, are posted in pairs:
   two sets that agree in no piece of many bits agree in a pair of such pieces. Nothing is lost.
3. Lists of one set, or without a set of the layout's own band, are dropped. Each other list has a hub, its member that
   meets most others, and gives (hub, member) rows only: a list of n makes n, not n squared.
4. In the tasks of a hub's group (``setjoin.links``), pairs whose sketches differ in more than k bits are left out, and
   the others are verified on the full sets. Pairs that are in one component already need no comparison.

Sets with fewer than 10 elements are linked only if they are equal; such sets are one class and are not posted.

Defined results: without words, or with a null text, a document has no shingles and is linked with nothing. With fewer
than three words the whole sequence is the one shingle. Rows that repeat are copies; ids may repeat with other texts. Rows
with a null id are linked like others; component_id is null where no id is reachable. No rows in, no rows out.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.setjoin import SetJoin, classes_of, links, mixed, resolved, signed
from newsmood.sources.shared import materialise

WORDS, PERCENT = 3, 90
LARGEST = 1 << 40  # shingles of a document


@cache
def lows(percent: int) -> tuple[int, ...]:
    """The smallest size of each band: a set of the next band can be linked with this band but not with the one before."""
    out = [1]
    while out[-1] < LARGEST:
        above = out[-1] * 100 // percent  # the least x with ceil(x * percent / 100) >= low
        while -(-above * percent // 100) < out[-1] or above <= out[-1]:
            above += 1
        out.append(above)
    return tuple(out)


def most_apart(size_a: int, size_b: int, percent: int) -> int:
    """How many elements linked sets of these sizes differ in at most."""
    return (100 - percent) * (size_a + size_b) // (100 + percent)


def layout(band: int, percent: int) -> tuple[int, int]:
    """(pieces, low): 0 pieces where only equal sets are linked. ``low`` falls with the number of pieces, so that a set
    has few of fewer bits."""
    largest = lows(percent)[band + 1] - 1
    k = most_apart(largest, largest, percent)
    pieces = k + 2 if k else 0
    return pieces, next(low for most, low in ((500, 4), (2_000, 3), (10_000, 2), (100_000, 1), (LARGEST, 0))
                        if pieces <= most)


def sketch(found: np.ndarray, pieces: int) -> np.ndarray:
    """The parity sketch: ``pieces`` words of 64 bits."""
    at = ((found >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    flips = np.bincount((at * np.uint64(64) + (found & np.uint64(63))).astype(np.int64), minlength=64 * pieces)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.uint64)


def _numbers(words: np.ndarray, of: np.ndarray, band: int) -> np.ndarray:
    """A 64-bit number for each (layout, piece, bits). Where two meet by chance, verification tells them apart."""
    return mixed(mixed(words ^ np.uint64(0x9E3779B97F4A7C15)) + of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                 + np.uint64(band * 0x165667B19E3779F9 % 2**64))


def postings(found: np.ndarray, band: int, percent: int) -> np.ndarray:
    """The numbers of the lists of a layout that a set is posted in."""
    pieces, low = layout(band, percent)
    if not pieces:
        return np.empty(0, np.uint64)
    words = sketch(found, pieces)
    numbers = _numbers(words, np.arange(pieces), band)
    few = np.bitwise_count(words) < low
    one, two = np.triu_indices(int(few.sum()), 1)
    pairs = numbers[few]
    return np.concatenate([numbers[~few], mixed(pairs[one] * np.uint64(3) + pairs[two])])


class ParityJoin(SetJoin):
    """``post`` gives the lists of the own layout, with the last bit set, and those of the next, with it clear."""

    payload = "array<bigint>"

    def __init__(self, words: int = WORDS, percent: int = PERCENT):
        self.words, self.percent = words, percent

    def post(self, found: np.ndarray) -> list[int]:
        band = bisect_right(lows(self.percent), len(found)) - 1
        own, above = postings(found, band, self.percent), postings(found, band + 1, self.percent)
        return np.concatenate([own | np.uint64(1), above & ~np.uint64(1)]).view(np.int64).tolist()

    def prepared(self, sets: list[np.ndarray]) -> np.ndarray:
        largest = max(len(s) for s in sets)
        pieces = most_apart(largest, largest, self.percent) + 2
        return np.stack([sketch(s, pieces) for s in sets])

    def may(self, state: np.ndarray, size: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(state[others] ^ state[k]).sum(axis=1).astype(np.int64)
        return (100 + self.percent) * apart <= (100 - self.percent) * (size[others] + size[k])


def members_of(classes: DataFrame) -> DataFrame:
    """(hub, cls, n_shingles): all classes that share a list, by the hub of the list; hubs are their own members."""
    one, rest = F.lit(1).cast("long"), F.lit(-2).cast("long")
    posted = (classes.select("cls", "n_shingles", F.explode("payload").alias("number"))
              .select("cls", "n_shingles", F.col("number").bitwiseAND(rest).alias("list"),
                      F.col("number").bitwiseAND(one).alias("own")))
    lists = (posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
             .where("n > 1 AND own = 1").select("list", "n"))
    shared = materialise(posted.drop("own").join(materialise(lists, "lists"), "list"), "shared")
    meets = materialise(shared.groupBy("cls").agg(F.sum("n").alias("meets")), "meets")
    hubs = materialise(shared.join(meets, "cls").groupBy("list")
                       .agg(F.max(F.struct("meets", "cls")).getField("cls").alias("hub")), "hubs")
    return materialise(shared.join(hubs, "list").select("hub", "cls", "n_shingles").distinct(), "members")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    join = ParityJoin(words, percent)
    every = materialise(signed(docs, join), "signed")
    classes = classes_of(every)
    found = links(docs, classes, members_of(classes), join)
    return resolved(every, classes, found).select("doc_id", "n_shingles", "component_id")
