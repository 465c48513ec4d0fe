"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

1. Words, hashed 5-word shingles and a signature of ``COORDINATES`` minima for every document. Documents with equal
   shingle sets are one class with a number of its own; from here on only classes count.
2. Posting: a class is posted under each (coordinate, value). Lists of one class are dropped. A pair that agrees in
   ``MATCHES`` coordinates must meet in a list that is not among the ``MATCHES - 1`` longest of either class, so these
   long lists are skipped (prefix filter, rarest first).
3. Each remaining list has a hub, its member that meets most others over all its lists. Only (hub, member) pairs leave
   a list, so a list of n classes makes n - 1 rows. All pairs of a list share its hub's group.
4. The texts of grouped classes are shingled once more and their full sets meet in the tasks of the group
   (``setjoin.links``). There the collisions of signatures are counted, and pairs above the match threshold are confirmed
   on the full sets: first all members against the hub, then the others against those of other components.
5. The components of the links are the result.

A pair at the threshold of similarity agrees in a coordinate with probability 0.75; that it agrees in fewer than 9 of
32 has a probability of 4e-9, and of less for more similar pairs. That is the only way to lose a link.

Defined results: without words, or with a null text, a document has no shingles and is linked with nothing. With fewer
than five words the whole sequence is the one shingle. Rows that repeat are copies. Ids may repeat with other texts: each
row is in the component of its own text. Rows with a null id are linked like others; component_id is the smallest id that
is not null, and null where there is none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm import setjoin
from newsmood.llm.setjoin import SetJoin
from newsmood.sources.shared import materialise

COORDINATES, MATCHES, WORDS = 32, 9, 5
PERCENT = 75

_RANDOM = np.random.default_rng(2025)
SLOPES = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 4096):
        hashed = (found[at:at + 4096, None] * SLOPES + SHIFTS) >> np.uint64(32)
        least = np.minimum(least, hashed.min(axis=0).astype(np.uint32))
    return least


class MinHashJoin(SetJoin):
    words, percent, payload = WORDS, PERCENT, "array<int>"

    def post(self, found: np.ndarray) -> list[int]:
        return signature(found).view(np.int32).tolist()

    def prepared(self, sets: list[np.ndarray]) -> np.ndarray:
        return np.stack([signature(s) for s in sets])

    def may(self, state: np.ndarray, size: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
        """Those with enough collisions of signatures."""
        return (state[others] == state[k]).sum(axis=1) >= MATCHES


JOIN = MinHashJoin()


def stars(classes: DataFrame) -> DataFrame:
    """(hub, cls, n_shingles) of all members of all groups, hubs among their own members.

    ``classes``: cls, n_shingles, payload. Spark takes a row for one posting and a stored table for the size of its packed
    file, many times too small, so both joins say that they are no broadcasts.
    """
    posted = (classes.select("cls", "n_shingles", F.posexplode("payload").alias("at", "value"))
              .select("cls", "n_shingles",
                      (F.shiftleft(F.col("at").cast("long"), 32)
                       + F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("list")))
    lengths = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # of the lists that a class shares with others, the longest MATCHES - 1 are skipped
    shared = posted.hint("merge").join(lengths, "list").groupBy("cls", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("n", "list"))).alias("lists"), F.sum("n").alias("meets"))
    kept = (shared.where(F.size("lists") >= MATCHES)
            .select("cls", "n_shingles", "meets",
                    F.explode(F.slice("lists", F.lit(1), F.size("lists") - F.lit(MATCHES - 1)).getField("list"))
                    .alias("list")))
    kept = materialise(kept, "postings")
    hubs = (kept.groupBy("list").agg(F.max(F.struct("meets", (-F.col("cls")).alias("first"))).alias("hub"),
                                     F.count(F.lit(1)).alias("n"))
            .where("n > 1").select("list", (-F.col("hub.first")).alias("hub")))
    return materialise(kept.hint("merge").join(hubs, "list").select("hub", "cls", "n_shingles").distinct(), "stars")


def _solved(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, component) of every row."""
    every = materialise(setjoin.signed(docs, JOIN), "signed")
    classes = setjoin.classes_of(every)
    return setjoin.resolved(every, classes, setjoin.links(docs, classes, stars(classes), JOIN))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _solved(docs).select("doc_id", "n_shingles", "component_id",
                                F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each component, with the columns they came with: the row with the smallest id, of
    several with that id one; rows without shingles stay. Nothing is kept or dropped by the id alone."""
    return setjoin.keep_first(docs, id_col, text_col, _solved)
