"""Cutting lineage so that the result survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``written`` has made in this process, by session.
_MADE: dict[int, list[str]] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="assayframe-ck-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; ``clear_scratch`` deletes it."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(id(spark.sparkContext), []).append(path)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, so that later jobs read only the columns they need."""
    path = scratch_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(schema).parquet(path)


def clear_scratch(spark: SparkSession) -> list[str]:
    """Delete all scratch folders of this session and return them; results that still read them must be stored before."""
    paths = _MADE.pop(id(spark.sparkContext), [])
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return paths
