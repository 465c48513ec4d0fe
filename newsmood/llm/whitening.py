"""Embedding whitening: rows on the leading eigenvectors of their covariance, each with variance 1.

1. Components become whole numbers x = floor(64 c) + 1000000. The fit list is each distinct x vector once: a map-side
   aggregate, so a vector that a third of all rows share counts as one and weighs no more than another.
2. n and the sums S of the fit list, exact: every task adds up its own, the few rows that come out meet in Spark.
3. Blockwise QR: a task stacks the rows x - S / n of a batch under its triangular factor and reduces both again. The
   factors of all tasks are reduced in the same way, ``FAN`` at a time, until one of d x d is left.
4. Householder reflections make that factor bidiagonal, dqds finds its singular values and twisted factorisations its
   right singular vectors (``bidiagonal``): the eigenvectors of the covariance, without forming it.
5. The covariance of the whitened fit list is added up from centred blocks, to see how far it is from the identity.

Only S, the factor of d x d, the directions and a matrix of 16 x 16 reach the driver.

Defined results: a row takes no part when its vector is null, has a null or non-finite component, a component whose x
does not fit a long, or another length than most; rows that repeat and rows without an id are projected like any other.
Components are left out where the variance is zero to working accuracy; without rows there are none. ``deviation`` is
null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.bidiagonal import right_vectors
from newsmood.llm.common import map_batches, ship_code
from newsmood.sources.shared import materialise

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
FAN = 32
ROWS = 4096  # rows of a block


def whole(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: F.try_add(F.floor(c.cast("double") * SCALE), F.lit(SHIFT).cast("long")))
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    good = (rows.where(F.col(vector_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
            .where(F.forall("x", lambda c: c.isNotNull())))
    length = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("x") == (length.n if length else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column(0).slice(at, ROWS))


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension, as whole numbers of any size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for block in _blocks(batches):
            exact = np.abs(block).max(initial=0) < 2**50  # 4,096 rows of these fit 64 bits
            part = block.sum(axis=0).astype(object) if exact else block.astype(object).sum(axis=0)
            n, total = n + len(block), part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()),
                 pa.array([str(int(t)) for t in total])], ["at", "n", "total"])

    parts = fit.select("x").mapInArrow(run, "at int, n long, total string")
    found = (parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38, 0)")).alias("total"))
             .orderBy("at").collect())  # a row for each dimension
    return (found[0].n if found else 0), [int(r.total) for r in found]


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers where they are sure to fit, else Python's."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 2**62 and max((abs(t) for t in total), default=0) < 2**62:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def _folded(parts: DataFrame, fold: Callable[[list[bytes]], bytes]) -> bytes | None:
    """The fold of the one-column rows ``state``, ``FAN`` at a time until one is left: every round is a table of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for state in batch.column(0).to_pylist():
                held.append(state)
                if len(held) == FAN:
                    held = [fold(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([fold(held)], pa.binary())], ["state"])

    parts = materialise(parts, "fold")
    while (n := parts.count()) > 1:
        parts = materialise(parts.repartition(-(-n // FAN)).mapInArrow(run, "state binary"), "fold")
    first = parts.first()
    return bytes(first.state) if first else None


def triangular(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the rows x - S / n."""
    d = len(total)

    def reduced(stacked: np.ndarray) -> np.ndarray:
        return np.linalg.qr(stacked, mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, d))
        for block in _blocks(batches):
            centred = deviations(block, n, total).astype(np.float64) / n
            r = reduced(np.vstack([r, centred]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["state"])

    def fold(states: list[bytes]) -> bytes:
        return reduced(np.vstack([np.frombuffer(s).reshape(-1, d) for s in states])).tobytes()

    r = np.frombuffer(_folded(fit.select("x").mapInArrow(run, "state binary"), fold) or b"").reshape(-1, d)
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])


def spread(blocks: Iterator[np.ndarray]) -> np.ndarray:
    """(n, mean, centred products) of the rows of the blocks in one vector: each block is centred at its own mean before
    it is multiplied, and blocks are put together by the distance of their means."""
    state = None
    for block in blocks:
        mean = block.mean(axis=0)
        away = block - mean
        part = np.concatenate([[len(block)], mean, (away.T @ away).ravel()])
        state = part if state is None else joined(state, part)
    return state


def joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    k = int(np.sqrt(len(one)))  # 1 + k + k * k
    n, m = one[0], two[0]
    apart = two[1:k + 1] - one[1:k + 1]
    return np.concatenate([[n + m], one[1:k + 1] + apart * (m / (n + m)),
                           one[k + 1:] + two[k + 1:] + np.outer(apart, apart).ravel() * (n * m / (n + m))])


def identity_error(fit: DataFrame, n: int, total: list[int], directions: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = spread((deviations(block, n, total).astype(np.float64) / n) @ directions for block in _blocks(batches))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], ["state"])

    def fold(states: list[bytes]) -> bytes:
        state = np.frombuffer(states[0])
        for other in states[1:]:
            state = joined(state, np.frombuffer(other))
        return state.tobytes()

    state = np.frombuffer(_folded(fit.select("x").mapInArrow(run, "state binary"), fold))
    return float(np.abs(state[k + 1:].reshape(k, k) / n - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that takes part and each
    component, numbered from 1 by falling variance."""
    ship_code(rows.sparkSession)
    usable = whole(rows, id_col, vector_col)
    fit = materialise(usable.select("x").distinct(), "fit-list")
    n, total = sums(fit)
    values, vectors, trace, error = np.empty(0), np.empty((len(total), 0)), 1.0, 0.0
    if n and total:
        r = triangular(fit, n, total)
        trace = float((r * r).sum() / n)
        found, vectors = right_vectors(r, components)
        values = found / n
        vectors = vectors / np.sqrt(values)
        error = identity_error(fit, n, total, vectors) if len(values) else 0.0
    k, explained = len(values), values / trace
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for at in range(0, batch.num_rows if k else 0, ROWS):
                ids, x = batch.column(0).slice(at, ROWS), _matrix(batch.column(1).slice(at, ROWS))
                away = deviations(x, n, total)
                if away.dtype == object or int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] >= 2**63:
                    far = [s if s < 2**63 else None for s in (sum(v * v for v in row) for row in away.astype(object))]
                else:
                    far = (away * away).sum(axis=1)
                white = (away.astype(np.float64) / n) @ vectors
                m, every = len(ids), pa.array(np.repeat(np.arange(len(ids)), k))
                out.append(pa.RecordBatch.from_arrays(
                    [ids.take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n, np.int64)), pa.array(far, pa.int64()).take(every), pa.array(white.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names))
            if not out:
                return None
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return each

    return map_batches(usable, make, "vec_id long, component int, n long, deviation long, whitened double, "
                                     "explained double, identity_error double")
