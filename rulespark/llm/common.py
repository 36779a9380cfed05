"""Shared plumbing: the checkpoint folder, written intermediates, Arrow limits."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.runtime import ship

#: Bytes of text that one Arrow batch hands to a Python worker.
BATCH_BYTES = 8 << 20
#: Rows in one Arrow batch, at most.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory does not follow text length; and see
    that workers have this package."""
    ship(spark)
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if not now or not now.isdigit() or not 0 < int(now) <= value:
            spark.conf.set(name, str(value))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Unset, it is a temporary one in local mode; on a
    cluster, where executors could not read what others write there, it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="rulespark-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def filesystem(spark: SparkSession, path: str):
    """(Hadoop FileSystem, Path) of a path in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, where = filesystem(spark, path)
        fs.delete(where, True)
    except Exception:  # the session has ended: the folder's owner cleans up
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this driver process ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/rulespark/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    a Python stage behind ``df`` runs once however often the result is used.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own, n = f"_{name}", 0
        while own.lower() in taken:
            n += 1
            own = f"_{name}_{n}"
        taken.add(own.lower())
        out.append(own)
    return out


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)
