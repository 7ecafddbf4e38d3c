"""Cutting lineage in iterative plans: reliable checkpoints and written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the checkpoint folder that the session has; on a local master else a temporary one.

    A cluster whose settings name none gets an error: a folder of one machine would hold a part of each table only.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if known:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(known)
        return known
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="amberlog-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder: later plans start afresh from it, whichever executors are lost.

    A written table rather than ``checkpoint()``, whose result carries the constraints of the plan it came from; in iterations with
    conditions those multiply from round to round, and planning soon takes longer than the work.
    """
    return written(df, "cut")


_made: list = []


def _clean_up() -> None:
    for path, fs in _made:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone; then the folder's owner clears it
            return


atexit.register(_clean_up)


def _kept(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    _made.append((jpath, fs))
    return jpath, fs


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _kept(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, with column pruning and filter pushdown for later reads; removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    at = _kept(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = at
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that no later plan reads (one that a newer one has taken the place of)."""
    at = getattr(df, "_written_at", None)
    if at is not None:
        at[1].delete(at[0], True)
