"""Exact deduplication with Patricia tries that own the texts of a partition.

1. Every map task collapses the copies it reads itself: one row for each distinct normalised text, with the number of
   copies and the owner among them. So a group of copies that holds a third of all rows leaves a task as one row.
2. These rows are partitioned by length and content hash. A task inserts the full byte strings of its partition into a
   compressed radix trie, whose terminal nodes store the owner and the count. Equality is that of whole byte strings;
   the hash only deals out. Beyond a memory budget the heaviest subtree is spilled to a file of the task and worked
   off afterwards by a trie of its own.
3. The owners, one short row for each distinct text, are joined back to the documents by digest. Spark splits the
   partitions of a hot digest at run time (adaptive skew join).

The terminal node's owner is the smallest identifier of the trie's order; ``keep="largest"`` turns the order round.

Defined results: null text is an empty text, and empty texts are equal. A row that repeats with its id is a copy like
any other. A null id is never preferred to another id. No rows in, no rows out. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import free_name, id_and_text, map_batches, values, with_ids
from newsmood.sources.shared import materialise

HELD = 192 << 20  # bytes of text that the trie of a task holds before it spills
SEEN = 64 << 20  # bytes of text that a map task holds while it collapses its own copies


class Node:
    """``label`` leads here from the parent; ``owner`` and ``count`` are set where a string ends."""

    __slots__ = ("label", "kids", "owner", "count")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.count = label, {}, None, 0


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _before(a: int | None, b: int | None, largest: bool) -> int | None:
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


class OwnerTrie:
    """A radix trie over byte strings. ``insert`` any number of strings, then read ``owners`` once."""

    def __init__(self, largest: bool, budget: int = HELD, prefix: bytes = b""):
        self.largest, self.budget, self.prefix = largest, budget, prefix
        self.root, self.held = Node(b""), 0
        self.weight: dict[int, int] = {}  # bytes held by each subtree of the root
        self.spilled: dict[int, Spill] = {}

    def insert(self, data: bytes, owner: int | None, count: int) -> None:
        first = data[0] if data else -1
        if first in self.spilled:
            self.spilled[first].add(data, owner, count)
            return
        node, at, new = self.root, 0, 0
        while at < len(data):
            kid = node.kids.get(data[at])
            if kid is None:
                kid = node.kids[data[at]] = Node(data[at:])
                node, new = kid, len(kid.label)
                break
            size = len(kid.label)
            if data.startswith(kid.label, at):
                node, at = kid, at + size
                continue
            same = _common(kid.label, data[at:at + size])
            upper = node.kids[data[at]] = Node(kid.label[:same])
            kid.label = kid.label[same:]
            upper.kids[kid.label[0]] = kid
            node, at = upper, at + same
        if node.count:
            node.owner = _before(node.owner, owner, self.largest)
        else:
            node.owner = owner
            new += 200
        node.count += count
        if new and first >= 0:
            self.held += new
            self.weight[first] = self.weight.get(first, 0) + new
            if self.held > self.budget:
                self._spill()

    def _spill(self) -> None:
        """Moves the heaviest subtree of the root to a file; its later strings go there directly."""
        first = max(self.weight, key=self.weight.get)
        spill = self.spilled[first] = Spill()
        for data, owner, count in _terminals(self.root.kids.pop(first), b""):
            spill.add(data, owner, count)
        self.held -= self.weight.pop(first)

    def owners(self) -> Iterator[tuple[bytes, int | None, int]]:
        """(string, owner, count) of every distinct string."""
        for data, owner, count in _terminals(self.root, self.prefix):
            yield data, owner, count
        self.root = Node(b"")
        for spill in self.spilled.values():
            below = OwnerTrie(self.largest, self.budget, self.prefix + spill.common)
            for data, owner, count in spill.read():
                below.insert(data[len(spill.common):], owner, count)
            yield from below.owners()


def _terminals(top: Node, above: bytes) -> Iterator[tuple[bytes, int | None, int]]:
    stack = [(top, above)]
    while stack:
        node, before = stack.pop()
        path = before + node.label
        if node.count:
            yield path, node.owner, node.count
        stack.extend((kid, path) for kid in node.kids.values())


class Spill:
    """Strings of one subtree in an unnamed file of the task, which is gone when the task ends."""

    def __init__(self):
        self.file, self.common = tempfile.TemporaryFile(), None

    def add(self, data: bytes, owner: int | None, count: int) -> None:
        self.common = data if self.common is None else self.common[:_common(self.common, data)]
        head = b"%d %s %d\n" % (len(data), b"-" if owner is None else b"%d" % owner, count)
        self.file.write(head)
        self.file.write(data)

    def read(self) -> Iterator[tuple[bytes, int | None, int]]:
        self.file.seek(0)
        while head := self.file.readline():
            size, owner, count = head.split()
            yield self.file.read(int(size)), None if owner == b"-" else int(owner), int(count)
        self.file.close()


def normalised(text: str) -> bytes:
    """A-Z lower-cased, nothing else: bytes.lower() leaves all but ASCII letters alone."""
    return text.encode("utf-8", "replace").lower()


def _own_copies(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([len(x) for x in seen], pa.int64()), pa.array([x[2] for x in seen.values()], pa.binary()),
                 pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()),
                 pa.array([x[1] for x in seen.values()], pa.int64())],
                ["size", "sha", "data", "owner", "copies"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
                data = normalised(text)
                known = seen.get(data)
                if known:
                    known[0], known[1] = _before(known[0], doc_id, largest), known[1] + 1
                    continue
                seen[data] = [doc_id, 1, hashlib.sha256(data).digest()]
                held += len(data)
                if held > SEEN:
                    yield rows()
                    seen, held = {}, 0
        if seen:
            yield rows()

    return run


def _tries(largest: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = OwnerTrie(largest, budget)
        for batch in batches:
            for row in zip(*(values(c) for c in batch.columns), strict=True):
                trie.insert(*row)
        out = []
        for data, owner, count in trie.owners():
            out.append((hashlib.sha256(data).hexdigest(), owner, count))
            if len(out) == 10_000:
                yield _owner_rows(out)
                out = []
        if out:
            yield _owner_rows(out)

    return run


def _owner_rows(rows: list[tuple]) -> pa.RecordBatch:
    sha, owner, count = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sha), pa.array(owner, pa.int64()), pa.array(count, pa.int64())],
                                      ["text_sha256", "keep_id", "group_size"])


def owners(docs: DataFrame, keep: str = "largest", budget: int = HELD) -> DataFrame:
    """(text_sha256, keep_id, group_size): one row for each distinct normalised text."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    largest = keep == "largest"
    own = id_and_text(docs).mapInArrow(
        _own_copies(largest), "size long, sha binary, data binary, owner long, copies long")
    dealt = own.repartition("size", F.col("sha")).select("data", "owner", "copies")
    return dealt.mapInArrow(_tries(largest, budget), "text_sha256 string, keep_id long, group_size long")


def digests(docs: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text_sha256) of the normalised texts, and the columns ``more`` of whole numbers."""
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sha = [hashlib.sha256(normalised(t)).hexdigest() for t in values(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha), *batch.columns[2:]],
                                              ["doc_id", "text_sha256", *more])

        return each

    schema = ", ".join(["doc_id long", "text_sha256 string", *(f"{c} long" for c in more)])
    return map_batches(id_and_text(docs, more=more), make, schema)


def exact_groups(docs: DataFrame, keep: str = "largest", budget: int = HELD) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return (digests(docs).join(owners(docs, keep, budget), "text_sha256")
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def keep_one(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one for each distinct normalised text, with the columns they came with.

    The rows are stored once, each with a key of its own. Of the rows with a text and its owner's id, which may be null,
    the one with the smallest key stays, so ids may repeat. The rows of a text and id are one before the join.
    """
    row = free_name(docs, "row_key")
    stored = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "to-dedup")
    named = stored.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row).alias("row"))
    first = digests(named, ["row"]).groupBy("text_sha256", "doc_id").agg(F.min("row").alias("row"))
    own = owners(named, keep).select(F.col("text_sha256").alias("owned"), "keep_id")
    wanted = first.join(own, (F.col("text_sha256") == F.col("owned")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return with_ids(stored, wanted.select("row"), row).select(*docs.columns)
