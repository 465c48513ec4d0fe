"""Approximate nearest neighbours with a permutation index.

Every vector is represented by its nearest pivots, in order of nearness, and posted in the inverted file of each of them
with the place it has there. A file is ordered by place. A query reads the files of its own nearest pivots only, in each
the places within ``WINDOW`` of its own, and adds up how near the places are: that is the footrule distance, of which every
pivot that the vector does not have, or has too far off, makes the largest share. The files are cut into blocks of vectors;
the best ``SHARE`` of each block, and of all blocks at least ``LEAST`` vectors, are reranked by the exact distance on the
original vectors in double precision; a block gives each query its nearest few, and the blocks' answers are merged.

The pivots are a bounded sample (``PIVOTS`` vectors); every vector is indexed and can be found by every query. Queries are
a given set of rows, met with the index in blocks of both, so a task holds one block of each. Equal vectors are one
class, searched for once and indexed once with the few smallest ids that an answer can need, so a vector that a third
of all rows share is no larger than any other.

Vectors that are null, all zero, of another length than most, or that hold null or non-finite components take no part.
Neither do rows without an id. Ties go to the smaller id; rows that repeat with one id count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood.llm.common import map_batches, ship_code
from newsmood.sources.shared import materialise

PIVOTS, KEPT, WINDOW = 2048, 64, 48
SHARE, LEAST = 0.06, 1000
BLOCK, QUERY_BLOCK = 8192, 4096


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the vectors that take part."""
    vec = F.col("vec")
    good = (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
            .where(F.col("vec_id").isNotNull() & vec.isNotNull()
                   & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
                   & F.exists(vec, lambda x: x != 0)))
    length = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vec") == (length.n if length else -1))


def classes(good: DataFrame, asked: Column, k: int) -> DataFrame:
    """(cls, ids, vec, asked): different vectors with their k + 1 smallest ids; cls is the smallest.

    ``row_number() <= k + 1`` leaves a map task with that many rows of a vector, however many rows share it.
    """
    marked = good.withColumn("asked", asked)
    first = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = good.dropDuplicates(["vec_id"]).withColumn("n", first).where(F.col("n") <= k + 1)
    of_class = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    wanted = marked.where("asked").select("vec").distinct().withColumn("asked", F.lit(True))
    return (of_class.join(wanted, "vec", "left")
            .select(F.col("ids")[0].alias("cls"), "ids", "vec", F.coalesce("asked", F.lit(False)).alias("asked")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def permutations(points: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    """The numbers of the nearest pivots of each point, nearest first."""
    far = (pivots * pivots).sum(axis=1) - 2 * points.astype(np.float64) @ pivots.T
    near = np.argpartition(far, kept - 1, axis=1)[:, :kept]
    return np.take_along_axis(near, np.lexsort((near, np.take_along_axis(far, near, 1)), axis=1), 1)


def with_order(rows: DataFrame, pivots: np.ndarray, kept: int) -> DataFrame:
    """``rows`` (cls, ids, vec, asked) and the pivots' order as 16-bit numbers in a binary column."""
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            order = permutations(_matrix(batch.column(2)), pivots, kept).astype(np.int16)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([o.tobytes() for o in order], pa.binary())],
                                              [*batch.schema.names, "places"])

        return each

    vec = rows.schema["vec"].dataType.simpleString()
    return map_batches(rows, make, f"cls long, ids array<long>, vec {vec}, asked boolean, places binary")


class InvertedFiles:
    """The vectors of a block by (pivot, place), each file and each place in it a stretch of one array."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.kept = order.shape
        cell = (order.astype(np.int64) * self.kept + np.arange(self.kept)).ravel()
        at = np.argsort(cell, kind="stable")
        self.vector, self.place = at // self.kept, at % self.kept
        self.starts = np.searchsorted(cell[at], np.arange(pivots * self.kept + 1))

    def nearness(self, order: np.ndarray, window: int) -> np.ndarray:
        """For each vector ``kept`` for every pivot it shares with the query, less the distance of the two places; places
        more than ``window`` apart are not read."""
        own = np.arange(self.kept)
        begin = self.starts[order * self.kept + np.maximum(own - window, 0)]
        length = self.starts[order * self.kept + np.minimum(own + window, self.kept - 1) + 1] - begin
        read = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        near = self.kept - np.abs(self.place[read] - np.repeat(own, length))
        return np.bincount(self.vector[read], near, self.n)


def search(good: DataFrame, asked: Column, k: int = 10, pivots: int = PIVOTS, kept: int = KEPT, window: int = WINDOW,
           share: float = SHARE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row for which ``asked`` is true.

    ``good`` is what ``usable`` gives.
    """
    ship_code(good.sparkSession)
    every = classes(good, asked, k)
    every = materialise(every, "vectors")
    total = every.count()
    chosen = every.orderBy(F.xxhash64("cls"), "cls").limit(pivots).select("vec").collect()  # at most ``pivots`` rows
    if not chosen:
        return every.select(F.col("cls").alias("query_id"), F.lit(0).alias("rank"), F.col("cls").alias("vec_id"),
                            F.lit(0.0).alias("score")).where("false")
    points = np.array([r.vec for r in chosen], np.float64)
    kept = min(kept, len(points))
    index = materialise(with_order(every, points, kept), "permutations")
    blocks, query_blocks = -(-total // block), max(1, -(-index.where("asked").count() // QUERY_BLOCK))
    deal = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("b", deal(blocks, 1)).withColumn("q", every_of(query_blocks))
    right = (index.where("asked").withColumn("q", deal(query_blocks, 2)).withColumn("b", every_of(blocks))
             .select(*[F.col(c).alias(f"asked_{c}") for c in ("cls", "vec", "places", "b", "q")]))
    n_pivots = len(points)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            ids, cls = a.column("ids").to_pylist(), a.column("cls").to_numpy()
            vec, asked_vec = _matrix(a.column("vec")).astype(np.float64), _matrix(b.column("asked_vec")).astype(np.float64)
            order = np.frombuffer(b"".join(a.column("places").to_pylist()), np.int16).reshape(len(cls), -1)
            files = InvertedFiles(order, n_pivots)
            most = min(len(cls), int(np.ceil(max(share * len(cls), least * len(cls) / total, k + 1))))
            for query, at, places in zip(b.column("asked_cls").to_pylist(), asked_vec,
                                         b.column("asked_places").to_pylist(), strict=True):
                far = -files.nearness(np.frombuffer(places, np.int16).astype(np.int64), window)
                best = np.argpartition(far, most - 1)[:most]
                exact = np.sqrt(((vec[best] - at) ** 2).sum(axis=1))
                first = np.lexsort((cls[best], exact))[:k + 1]
                out += [(query, ids[best[i]], float(exact[i])) for i in first.tolist()]
        query, found, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query": pa.array(query, pa.int64()), "ids": pa.array(found, pa.list_(pa.int64())),
                         "score": pa.array(score, pa.float64())})

    met = (left.groupBy("b", "q").cogroup(right.groupBy("asked_b", "asked_q"))
           .applyInArrow(meet, "query long, ids array<long>, score double"))
    # the nearest k + 1 classes hold the nearest k + 1 ids, and with the query's own id removed at least k
    near = Window.partitionBy("query").orderBy("score", F.col("ids")[0])
    few = met.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    by_id = Window.partitionBy("query").orderBy("score", "vec_id")
    answers = (few.select("query", F.explode("ids").alias("vec_id"), "score")
               .withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).drop("n"))
    answers = answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    queries = (good.where(asked).dropDuplicates(["vec_id"])
               .join(index.where("asked").select("vec", F.col("cls").alias("query")), "vec")
               .select("query", F.col("vec_id").alias("query_id")))
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), F.lit(1), F.lit(k))
    return (queries.join(answers, "query").select("query_id", F.posexplode(own).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score"))
