"""What the operators share: reading tables, the columns they look at, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="newsmood-code-"), "newsmood_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text) and the columns ``more``, whatever else the table has; a null text is an empty one."""
    ship_code(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose id is, or with ``left_anti`` is not, in the one column of ``ids``."""
    key = free_name(docs, "wanted_id")
    return docs.join(ids.toDF(key), F.col(id_col).cast("long") == F.col(key), how)


def learns(rest: int, parts: int) -> Column:
    """Whether labels may be learnt from the row: crc32 of the id as text is not ``rest`` modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts != rest


def values(column: pa.Array, step: int = 512) -> Iterator:
    """The values of a column of texts, a few at a time: a batch may hold ten thousand."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


_KEPT: dict[object, object] = {}


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task. Only one at a time: another operator's drops the one before."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
                schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``make`` runs once in each task, for what is loaded first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
