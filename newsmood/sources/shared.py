"""The folder all executors share, for intermediate tables, stream state and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local master (a test) gets a folder of its own;
    on a cluster that is an error, as a machine-local folder would not be seen by the other machines."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="newsmood-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_MADE: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name. What is written there is gone after ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables this application has written, once its results are stored. How many they were."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows once to the shared folder and goes on from there, with a short lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
