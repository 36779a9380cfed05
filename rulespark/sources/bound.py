"""A Spark frame as a relation."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.functions import types as ty
from rulespark.operators import state
from rulespark.plans.relation import Shape


MERGED = 16


@dataclass
class Source:
    """``keys`` and ``value`` name columns. ``direct``: the rows are the items as they stand - the
    caller knows that the keys are unique, or wants each row to count by itself - so that no
    aggregation is planned and only the columns a rule reads are scanned."""

    frame: DataFrame
    keys: list[str]
    value: str | None
    direct: bool
    key: str | None = None
    #: The value column holds encoded terms.
    encoded: bool = False
    #: The frame first bound, and the written tables of rows inserted since, each with its level:
    #: ``MERGED`` tables of a level become one of the next.
    first: DataFrame | None = None
    batches: tuple[tuple[int, str], ...] = ()

    def grown(self, frame: DataFrame) -> "Source":
        """This source with the rows of ``frame`` too, which are written once."""
        columns = [c for c in (*self.keys, self.value, self.key) if c is not None]
        first = self.frame.select(columns) if self.first is None else self.first
        # As a union with the first frame would have it: its names, the wider types.
        wanted = first.unionByName(frame.select(columns)).schema
        own = frame.select(*(F.col(f.name).cast(f.dataType) for f in wanted))
        spark = frame.sparkSession
        batches = [*self.batches, (0, state.store(own))]
        while len(last := [b for b in batches if b[0] == batches[-1][0]]) == MERGED:
            level = batches[-1][0]
            batches = batches[: -len(last)] + [(level + 1, state.store(spark.read.schema(wanted).parquet(*(p for _, p in last))))]
        written = spark.read.schema(wanted).parquet(*(p for _, p in batches))
        return replace(self, frame=first.unionByName(written), first=first, batches=tuple(batches))

    def shape(self) -> Shape:
        kinds = {f.name: ty.of_spark(f.dataType) for f in self.frame.schema}
        return Shape([kinds[k] for k in self.keys], "term" if self.encoded else "bool" if self.value is None else kinds[self.value], None if self.key is None else kinds[self.key])

    def columns(self, shape: Shape) -> list:
        own = self.shape()
        out = [
            ty.coerce(F.col(k).cast(ty.ddl(t)), t, to).alias(f"a{i}")
            for i, (k, t, to) in enumerate(zip(self.keys, own.args, shape.args, strict=True))
        ]
        value = F.lit(True) if self.value is None else F.col(self.value).cast(ty.ddl(own.value))
        out.append(ty.coerce(value, own.value, shape.value).alias("value"))
        if shape.key is not None:
            key = F.lit(None).cast(ty.ddl(shape.key)) if self.key is None else ty.coerce(F.col(self.key).cast(ty.ddl(own.key)), own.key, shape.key)
            out.append(key.alias("key"))
        return out

    def rows(self) -> DataFrame:
        """Null is no item, in the value or in a key."""
        needed = [c for c in (*self.keys, self.value) if c is not None]
        return reduce(lambda f, c: f.where(F.col(c).isNotNull()), needed, self.frame)

    def items(self, shape: Shape) -> DataFrame:
        return self.rows().select(*self.columns(shape))

    def contributions(self, elements: Shape) -> DataFrame:
        return self.rows().select(*self.columns(elements), F.lit(-1).alias("rule"))
