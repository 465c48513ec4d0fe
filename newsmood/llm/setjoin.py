"""What the operators on shingle sets share: sets of words, classes of equal sets, exact comparison of groups, components.

A row's set is that of its distinct hashed shingles. Rows with equal sets are one class, with a number of its own; no step
identifies a row or a class by an id of the table, so ids may repeat with other texts or be null.

An operator says which classes may be linked by groups (hub, cls): every pair of one group is compared on full sets.
``links`` does that in two steps. First every group is taken apart into blocks of ``GROUP_BYTES`` of sets, each with the
hub's set, and compared within its blocks; most groups are one block, and in a group of near copies the hub links nearly
all members. Then only members of several blocks that are in another component than their hub are compared with the
members in other blocks, again in blocks of both sides. A set is copied once for each task that needs it, by several
tasks where these are many, in batches of bounded bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import free_name, id_and_text, map_batches, values, worker_cache
from newsmood.llm.components import components
from newsmood.sources.shared import materialise

GROUP_BYTES = 16 << 20
LEAST = 512  # bytes that a member counts at least, so that a block of small sets has a bounded number
VOCABULARY = 300_000  # words whose hashes a Python worker keeps before it starts again
MOST_WORDS = 8

_RANDOM = np.random.default_rng(2024)
FACTORS = _RANDOM.integers(1, 2**63, MOST_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct hashed shingles of ``size`` words, ascending; with fewer words the whole sequence is one.

    bytes.split() cuts at x20 and x09-x0D and nowhere else.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = worker_cache("word hashes", WordHashes)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(each) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(size, len(each))):
        total += each[i:i + n] * FACTORS[i]
    if len(each) < size:  # else a short sequence could meet a longer one that ends in a word hashed to 0
        total += np.uint64(len(each))
    return np.unique(mixed(total))


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def similar(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


class SetJoin:
    """What is particular to an operator: the length of a shingle, the threshold, what is posted, what is filtered."""

    words: int
    percent: int
    payload: str  # type of what ``post`` gives

    def post(self, found: np.ndarray) -> list[int]:
        """Numbers of a set by which groups are made."""
        raise NotImplementedError

    def prepared(self, sets: list[np.ndarray]):
        """What ``may`` needs of the sets of a group."""
        raise NotImplementedError

    def may(self, state, size: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` the operator's filter keeps for ``k``; it loses no link but as the operator documents."""
        raise NotImplementedError


def signed(docs: DataFrame, join: SetJoin) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, payload); set_key and payload are null without shingles. text_key, a hash of
    the text, helps to find a row again."""
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, keys, posts = [], [], []
            for text in values(batch.column(1)):
                found = shingles(text, join.words)
                counts.append(len(found))
                keys.append(set_key(found) if len(found) else None)
                posts.append(join.post(found) if len(found) else None)
            kind = pa.int64() if "bigint" in join.payload else pa.int32()
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(posts, pa.list_(kind))],
                ["doc_id", "text_key", "n_shingles", "set_key", "payload"])

        return each

    return map_batches(_texts(docs), make, "doc_id long, text_key long, n_shingles long, set_key binary, "
                                           f"payload {join.payload}")


def _texts(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def classes_of(every: DataFrame) -> DataFrame:
    """(cls, set_key, n_shingles, payload, least, text_key, rep_id): the different sets, numbered; ``least`` is the
    smallest id, text_key and rep_id are those of a row that has the set."""
    found = (every.where("n_shingles > 0").groupBy("set_key", "n_shingles", "payload")
             .agg(F.min("doc_id").alias("least"), F.min(F.struct("text_key", "doc_id")).alias("rep")))
    return materialise(found.select(
        F.monotonically_increasing_id().alias("cls"), "set_key", "n_shingles", "payload", "least",
        F.col("rep.text_key").alias("text_key"), F.col("rep.doc_id").alias("rep_id")), "classes")


class Overlaps:
    """Sizes of the intersections of the sets of a group. Elements that many sets have are bits of a matrix, which is
    smaller than the sets; others are looked up; those of one set do not matter."""

    def __init__(self, sets: list[np.ndarray]):
        n, sizes = len(sets), np.array([len(s) for s in sets])
        member = np.repeat(np.arange(n), sizes)
        _, element, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        many = (held >= 2) & (8 * held >= n)
        few = (held >= 2) & ~many
        here = many[element]
        bits = np.zeros((n, -(-int(many.sum()) // 64) * 64), np.uint8)
        bits[member[here], (np.cumsum(many) - 1)[element[here]]] = 1
        self.packed = np.packbits(bits, axis=1).view(np.uint64)
        here = few[element]
        number = (np.cumsum(few) - 1)[element[here]]
        self.own, self.length = number, held[few]
        self.own_from = np.concatenate([[0], np.cumsum(np.bincount(member[here], minlength=n))])
        self.holders = member[here][np.argsort(number, kind="stable")]
        self.holders_from = np.cumsum(self.length) - self.length
        self.n = n

    def common(self, k: int) -> np.ndarray:
        total = np.bitwise_count(self.packed & self.packed[k]).sum(axis=1).astype(np.int64)
        mine = self.own[self.own_from[k]:self.own_from[k + 1]]
        if len(mine):
            length = self.length[mine]
            at = np.repeat(self.holders_from[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            total += np.bincount(self.holders[at], minlength=self.n)
        return total


def spanning(join: SetJoin, ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, asked: np.ndarray,
             first: int) -> list[tuple[int, int]]:
    """Edges that, with the components the labels tell of, span those of the links between asked members and all."""
    size = np.array([len(s) for s in sets])
    group = np.unique(labels, return_inverse=True)[1]
    left = int(group.max()) + 1
    done = np.zeros(len(ids), bool)
    edges: list[tuple[int, int]] = []
    state, overlaps = join.prepared(sets), None
    order = np.flatnonzero(asked)
    for k in [*order[order == first].tolist(), *order[order != first].tolist()]:
        if left == 1:
            break
        done[k] = True
        others = np.flatnonzero(~done & (group != group[k]) & (
            100 * np.minimum(size, size[k]) >= join.percent * np.maximum(size, size[k])))
        if len(others):
            others = others[join.may(state, size, k, others)]
        if not len(others):
            continue
        overlaps = overlaps or Overlaps(sets)
        linked = others[similar(overlaps.common(k)[others], size[others], size[k], join.percent)]
        if len(linked):
            met, at = np.unique(group[linked], return_index=True)
            edges += [(int(ids[k]), int(ids[other])) for other in linked[at]]
            group[np.isin(group, met)] = group[k]
            left -= len(met)
    return edges


def _weight():
    return F.greatest(F.col("n_shingles") * 8, F.lit(LEAST))


def large_groups(members: DataFrame) -> DataFrame:
    """(hub, blocks) of the groups that are taken apart."""
    return materialise(members.groupBy("hub").agg(F.ceil(F.sum(_weight()) / GROUP_BYTES).cast("int").alias("blocks"))
                       .where("blocks > 1"), "large-groups")


def _own(column: str, seed: int = 0):
    return F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(column)).cast("int")


def first_tasks(members: DataFrame, large: DataFrame) -> DataFrame:
    """(cls, n_shingles, hub, i, j, label, asked, at): every member in its block, the hub in all blocks of its group."""
    blocks = F.coalesce("blocks", F.lit(1))
    block = F.when(F.col("cls") == F.col("hub"), F.sequence(F.lit(0), blocks - 1)).otherwise(
        F.array(F.coalesce(_own("blocks"), F.lit(0))))
    return (members.join(large, "hub", "left")
            .select("cls", "n_shingles", "hub", F.posexplode(block).alias("at", "i"))
            .select("cls", "n_shingles", "hub", "i", F.lit(0).alias("j"), F.col("cls").alias("label"),
                    F.lit(True).alias("asked"), "at"))


def later_tasks(members: DataFrame, large: DataFrame, found: DataFrame) -> DataFrame | None:
    """The same for members of large groups that are not in their hub's component, against all others; None without."""
    of = found.select(F.col("node").alias("cls"), "component")
    labelled = (members.join(large, "hub").join(of, "cls", "left")
                .withColumn("label", F.coalesce("component", "cls")).drop("component"))
    labelled = materialise(labelled, "labelled")
    hubs = labelled.where("cls = hub").select("hub", F.col("label").alias("hub_label"))
    loose = materialise(labelled.join(hubs, "hub").where("label <> hub_label").drop("hub_label"), "loose")
    if loose.isEmpty():
        return None
    shares = materialise(loose.groupBy("hub").agg(F.ceil(F.sum(_weight()) / GROUP_BYTES).cast("int").alias("shares")),
                         "shares")
    names = ["cls", "n_shingles", "hub", "i", "j", "label", "asked", "at"]
    asked = (loose.join(shares, "hub").withColumn("i", _own("shares", 1)).withColumn("asked", F.lit(True))
             .select("*", F.posexplode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at", "j")))
    every = (labelled.join(shares, "hub").withColumn("j", _own("blocks")).withColumn("asked", F.lit(False))
             .select("*", F.posexplode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("at", "i")))
    return asked.select(*names).unionByName(every.select(*names))


def sliced(tasks: DataFrame) -> DataFrame:
    """(cls, slice, groups): the tasks a class takes part in, in slices whose copies of its set hold ``GROUP_BYTES`` for
    each hub at most, or are one copy."""
    copies = F.greatest(F.lit(1), F.floor(F.lit(GROUP_BYTES) / (F.col("n_shingles") * 8)))
    return (tasks.select("cls", F.floor(F.col("at") / copies).cast("int").alias("slice"),
                         F.struct("hub", "i", "j", "label", "asked").alias("task"))
            .groupBy("cls", "slice").agg(F.collect_list("task").alias("groups")))


def copies_of(cls: int, found: np.ndarray, groups: list[tuple], most: int) -> Iterator[pa.RecordBatch]:
    """A set once for each of its tasks, in batches of ``most`` bytes of sets at most, or of one copy."""
    data = found.tobytes()
    step = max(1, most // len(data))
    for at in range(0, len(groups), step):
        hubs, firsts, seconds, labels, asked = zip(*groups[at:at + step], strict=True)
        n = len(hubs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hubs, pa.int64()), pa.array(firsts, pa.int32()), pa.array(seconds, pa.int32()),
             pa.array([cls] * n, pa.int64()), pa.array(labels, pa.int64()), pa.array(asked, pa.bool_()),
             pa.array([data] * n, pa.binary())], ["hub", "i", "j", "cls", "label", "asked", "found"])


def _full_sets(docs: DataFrame, classes: DataFrame, dealt: DataFrame, join: SetJoin) -> DataFrame:
    """(hub, i, j, cls, label, asked, found): the full set of each class, once for each of its tasks."""
    wanted = dealt.join(classes.select("cls", "set_key", F.col("text_key").alias("rep_key"), "rep_id"), "cls")
    texts = _texts(docs)
    rows = (texts.join(wanted, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
            .repartition("cls", "slice")
            .select("cls", "text", "set_key", *(F.col(f"groups.{c}") for c in ("hub", "i", "j", "label", "asked"))))
    most, words = GROUP_BYTES, join.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text, key, *tasks in zip(*(values(c, 64) for c in batch.columns), strict=True):
                found = shingles(text, words)
                if set_key(found) == key:  # else another text with this hash
                    yield from copies_of(cls, found, list(zip(*tasks, strict=True)), most)

    return rows.mapInArrow(run, "hub long, i int, j int, cls long, label long, asked boolean, found binary")


def _compared(docs: DataFrame, classes: DataFrame, tasks: DataFrame, join: SetJoin) -> DataFrame:
    def link(table: pa.Table) -> pa.Table:
        hub, rows = table.column("hub")[0].as_py(), {}
        for cls, label, asked, found in zip(*(table.column(c).to_pylist() for c in ("cls", "label", "asked", "found")),
                                            strict=True):  # repeated rows and both parts of a member are one
            rows[cls] = (label, asked or (cls in rows and rows[cls][1]), np.frombuffer(found, np.uint64))
        ids = np.array(sorted(rows), np.int64)
        labels, asked, sets = zip(*(rows[i] for i in ids.tolist()), strict=True)
        pairs = spanning(join, ids, list(sets), np.array(labels), np.array(asked), int(np.searchsorted(ids, hub)))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()),
                         "b": pa.array([p[1] for p in pairs], pa.int64())})

    return (_full_sets(docs, classes, sliced(tasks), join).groupBy("hub", "i", "j").applyInArrow(link, "a long, b long"))


def links(docs: DataFrame, classes: DataFrame, members: DataFrame, join: SetJoin) -> DataFrame:
    """(node, component): the components of the links within the groups ``members`` (hub, cls, n_shingles)."""
    large = large_groups(members)
    edges = materialise(_compared(docs, classes, first_tasks(members, large), join), "links")
    found = components(edges)
    if large.isEmpty():
        return found
    tasks = later_tasks(members, large, found)
    if tasks is None:
        return found
    return components(edges.unionByName(materialise(_compared(docs, classes, tasks, join), "links")))


def resolved(every: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The rows ``every`` with component_id, the smallest id of the component, and component, its number (null without
    shingles: such a row is its own)."""
    named = materialise(classes.join(found, F.col("cls") == F.col("node"), "left")
                        .select("set_key", "least", F.coalesce("component", "cls").alias("component")), "of-class")
    tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = named.drop("least").join(tops, "component")
    some = every.where("n_shingles > 0").join(of_set, "set_key")
    none = (every.where("n_shingles = 0").withColumn("component", F.lit(None).cast("long"))
            .withColumn("component_id", F.col("doc_id")))
    return some.unionByName(none)


def keep_first(docs: DataFrame, id_col: str, text_col: str, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that stay: of each component one with the smallest id, and every row without shingles; with the columns
    they came with. ``solve(named)`` gives (doc_id, text_key, component) of every row.

    A row is known by its id and a hash of its text together, so ids may repeat with other texts or be null. Of rows that
    are equal in both one stays.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = solve(named).where("component IS NOT NULL")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    alike = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    id_key, text_key = free_name(docs, "stays_id"), free_name(docs, "stays_text")
    winners = first.select(F.col("first.doc_id").alias(id_key), F.col("first.text_key").alias(text_key))
    winners = materialise(winners.join(
        alike, F.col(id_key).eqNullSafe(F.col("doc_id")) & (F.col(text_key) == F.col("text_key")))
        .select(id_key, text_key, "rows"), "winners")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    is_winner = F.col(id_col).cast("long").eqNullSafe(F.col(id_key)) & (F.xxhash64(text) == F.col(text_key))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == ""
    spoken = docs.where(~bare)
    kept = docs.where(bare).unionByName(spoken.join(winners.where("rows = 1").drop("rows"), is_winner, "left_semi"))
    repeated = winners.where("rows > 1").drop("rows")
    if repeated.isEmpty():
        return kept
    one = spoken.join(repeated, is_winner).dropDuplicates([id_key, text_key]).select(*docs.columns)
    return kept.unionByName(one)
