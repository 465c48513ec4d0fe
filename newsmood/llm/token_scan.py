"""Token counts from flat token files that have no index: a scan for the end-of-document id.

A flat file is nothing but ids of fixed width, little-endian, each document closed by the end id. ``write_flat`` makes
such files with Spark's own writer. ``document_lengths`` reads any number of them:

1. Every file is searched in blocks of ``block`` ids, each block by one vectorised comparison. A block knows neither
   where its first document began nor which document that is; it goes on as one row with the places of its separators.
2. A prefix scan over the block rows of a file carries the last separator and the number of documents before each
   block, so documents that lie across blocks are stitched together without looking at ids again.
3. Each block turns its separators, with what was carried in, into (doc_no, start, n_tokens).

A file is read as one binary value, which a task holds: ``write_flat`` starts a new file after ``chunks`` stretches of
about a megabyte, so that it is of a known size unless a single document is larger. Ids after the last separator are a document that was cut off; it counts, closed = false.
Defined results: an empty document has 0 tokens, an empty file has no documents, a file whose size is no multiple of
the width is an error. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsmood.llm.common import id_and_text, map_batches
from newsmood.llm.packing import word_ids

BLOCK = 1 << 20  # ids in a block
MEMO_WORDS, SLICE_BYTES = 300_000, 4 << 20  # less than packing takes: the files themselves need memory here
CHUNK_BYTES, CHUNKS = 1 << 20, 8  # files of some 8 MB, for executors of 3 GB; more with more memory
WIDTHS = {2: "<u2", 4: "<u4"}


def write_flat(docs: DataFrame, path: str, vocabulary: str, pattern: str, end_id: int, width: int = 2,
               chunks: int = CHUNKS, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes the ids of every text, each closed by ``end_id``, to files of a folder, in the order of the tasks' rows.

    A row of the writer is a stretch of documents with the end id between them, as raw bytes; the end id is the writer's
    line separator as well.
    """
    kind, end = WIDTHS[width], end_id.to_bytes(width, "little")

    def make():
        memo = word_ids(vocabulary, pattern, MEMO_WORDS, SLICE_BYTES)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, held, size = [], [], 0
            for ids in memo.batch(batch.column(1)):
                held.append(ids.astype(kind).tobytes())
                size += len(held[-1])
                if size >= chunk_bytes:
                    rows.append(end.join(held))
                    held, size = [], 0
            if held:
                rows.append(end.join(held))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

        return each

    (map_batches(id_and_text(docs), make, "ids binary").select(F.col("ids").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("compression", "none")
     .option("maxRecordsPerFile", chunks).text(path))


def block_separators(ids: np.ndarray, end_id: int, block: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block number, ids in it, places of the end id in the file) of each block."""
    for at in range(0, len(ids), block):
        part = ids[at:at + block]
        yield at // block, len(part), np.flatnonzero(part == end_id).astype(np.int64) + at


def scan_blocks(files: DataFrame, end_id: int, width: int, block: int = BLOCK) -> DataFrame:
    """One row per block of each file: file, block, first, size, n_seps, last_sep, seps (packed 64-bit places)."""
    kind = WIDTHS[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_buffer()
                if data.size % width:
                    raise ValueError(f"{name}: {data.size} bytes are no multiple of {width}")
                rows = [(name.as_py(), k, n, len(seps), int(seps[-1]) if len(seps) else None, seps.tobytes())
                        for k, n, seps in block_separators(np.frombuffer(data, kind), end_id, block)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                            pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                        ["file", "block", "size", "n_seps", "last_sep", "seps"])

    return files.select("path", "content").mapInArrow(
        run, "file string, block long, size long, n_seps long, last_sep long, seps binary")


def stitch(blocks: DataFrame) -> DataFrame:
    """The documents of scanned blocks: file, doc_no (from 0), start, n_tokens, closed."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    carried = blocks.select(
        "file", "seps",
        F.coalesce(F.max("last_sep").over(before) + 1, F.lit(0)).alias("begun"),
        F.coalesce(F.sum("n_seps").over(before), F.lit(0)).alias("docs"),
        F.when(F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(),
               F.coalesce(F.sum("size").over(before), F.lit(0)) + F.sum("size").over(whole)).alias("end"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for name, packed, begun, docs, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seps = np.frombuffer(packed, np.int64)
                starts = np.concatenate([[begun], seps + 1])
                ends, closed = seps, np.ones(len(seps), bool)
                if end is not None and starts[-1] < end:
                    ends, closed = np.append(seps, end), np.append(closed, False)
                n = len(ends)
                if n:
                    out.append(pa.RecordBatch.from_arrays(
                        [pa.array([name]).take(pa.array(np.zeros(n, np.int64))),
                         pa.array(docs + np.arange(n)), pa.array(starts[:n].astype(np.int64)),
                         pa.array((ends - starts[:n]).astype(np.int64)), pa.array(closed)],
                        ["file", "doc_no", "start", "n_tokens", "closed"]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

        return each

    return map_batches(carried, make, "file string, doc_no long, start long, n_tokens long, closed boolean")


def document_lengths(spark: SparkSession, path: str, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, doc_no, start, n_tokens, closed of every document of the flat files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return stitch(scan_blocks(files, end_id, width, block))
