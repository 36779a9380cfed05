"""Relations held between rounds: small ones as rows, large ones as written tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a round keeps on the driver; more are written to the shared checkpoint folder.
SMALL = 2000
#: Tables that a relation which only grows is kept in, before they become one.
TABLES = 64


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Unset, it is a temporary one in local mode; on a
    cluster, where executors could not read what others write there, it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rulespark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of the shared folder, which outlives executors but not this process."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/rulespark/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def store(frame: DataFrame) -> str:
    """Writes a frame to the shared folder; its path."""
    path = scratch(frame.sparkSession, "relation")
    frame.write.parquet(path)
    return path


def written(frame: DataFrame, width: int) -> "Held":
    """Written once and read back: lineage ends here, and survives the loss of executors."""
    path = store(frame)
    return Held(frame.sparkSession.read.schema(frame.schema).parquet(path), width, None, (path,))


def extended(held: "Held", more: "Held") -> "Held":
    """Both relations' rows, of which the written ones are not written again. Many tables become one."""
    if more.rows is not None:
        more = written(more.frame, more.width)
    if held.rows is not None:
        held = written(held.frame, held.width)
    paths, spark = (*held.paths, *more.paths), held.frame.sparkSession
    frame = spark.read.schema(held.frame.schema).parquet(*paths)
    return Held(frame, held.width, None, paths) if len(paths) <= TABLES else written(frame, held.width)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner cleans up
        pass


def retire(old: list["Held"], live: list["Held"]) -> None:
    """Deletes the tables of earlier rounds that nothing reads any more."""
    kept = {p for h in live for p in h.paths}
    for h in old:
        for path in h.paths:
            if path not in kept:
                _remove(h.frame.sparkSession, path)


def local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A frame of given rows; it goes to the JVM as one Arrow table and is part of the plan."""
    if not rows:
        return spark.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([_arrow(r[i], f.dataType) for r in rows], arrow.field(i).type) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def _arrow(v, kind: T.DataType):
    if v is not None and isinstance(kind, T.StructType):
        return {f.name: _arrow(x, f.dataType) for f, x in zip(kind.fields, v, strict=True)}
    if v is not None and isinstance(kind, T.ArrayType):
        return [_arrow(x, kind.elementType) for x in v]
    return v


@dataclass
class Held:
    """A relation between rounds. ``rows``: {arguments: rest} if it is small, else None."""

    frame: DataFrame
    width: int
    rows: dict | None
    #: Where it is written, if it is.
    paths: tuple[str, ...] = ()

    def size_known_empty(self) -> bool:
        return self.rows is not None and not self.rows


def _plain(v):
    """Rows and lists as tuples, so that they can be keys."""
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def hold(frame: DataFrame, width: int, large: bool = False) -> Held:
    """``width``: number of arguments; ``large``: it was beyond ``SMALL`` the last time."""
    if not large:
        rows = frame.limit(SMALL + 1).collect()
        if len(rows) <= SMALL:
            return from_rows(frame.sparkSession, {_plain(tuple(r)[:width]): _plain(tuple(r)[width:]) for r in rows}, width, frame.schema)
    return written(frame, width)


def settled(frame: DataFrame, width: int) -> Held:
    """Like ``hold`` for a frame of unknown cost: it is computed once, written, and read if small."""
    held = written(frame, width)
    rows = held.frame.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        return held
    retire([held], [])
    return from_rows(frame.sparkSession, {_plain(tuple(r)[:width]): _plain(tuple(r)[width:]) for r in rows}, width, frame.schema)


def from_rows(spark: SparkSession, rows: dict, width: int, schema: T.StructType) -> Held:
    return Held(local(spark, [(*k, *v) for k, v in rows.items()], schema), width, rows)


def empty(spark: SparkSession, schema: T.StructType, width: int) -> Held:
    return Held(spark.createDataFrame([], schema), width, {})


def differences(old: Held, new: Held, columns: list[str]) -> tuple[bool, float]:
    """(whether anything differs, the largest relative change of a double; inf if more than that)."""
    if old.rows is not None and new.rows is not None:
        if old.rows == new.rows:
            return False, 0.0
        if old.rows.keys() != new.rows.keys():
            return True, float("inf")
        worst = 0.0
        for k, own in new.rows.items():
            for a, b in zip(old.rows[k], own, strict=True):
                if a != b:
                    if not (isinstance(a, float) and isinstance(b, float)):
                        return True, float("inf")
                    worst = max(worst, abs(a - b) / max(abs(a), abs(b), 1e-300))
        return worst > 0, worst
    if (old.rows is None) != (new.rows is None):
        return True, float("inf")
    rest = [c for c in new.frame.columns if c not in columns]
    a = old.frame.select(*(F.col(c).alias(f"o_{c}") for c in old.frame.columns), F.lit(True).alias("o_there"))
    b = new.frame.withColumn("n_there", F.lit(True))
    both = b.join(a, [b[c].eqNullSafe(a[f"o_{c}"]) for c in columns], "full_outer") if columns else b.crossJoin(a)
    there = F.col("o_there").isNotNull() & F.col("n_there").isNotNull()
    alike = there
    for c in rest:
        alike = alike & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    doubles = [f.name for f in new.frame.schema if f.name in rest and isinstance(f.dataType, T.DoubleType)]
    change = F.lit(float("inf"))
    if doubles == rest:
        own = [F.abs(F.col(c) - F.col(f"o_{c}")) / F.greatest(F.abs(c), F.abs(f"o_{c}"), F.lit(1e-300)) for c in doubles]
        change = F.when(there, F.greatest(*own) if len(own) > 1 else own[0]).otherwise(F.lit(float("inf")))
    found = both.where(~F.coalesce(alike, F.lit(False))).agg(F.count("*").alias("n"), F.max(change).alias("w")).first()
    return found["n"] > 0, found["w"] or 0.0
