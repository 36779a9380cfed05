"""Feeds a program from Structured Streaming.

Each micro-batch is reduced to signed or folded contributions and appended, under its batch id,
to a folder that a relation is bound to: a batch that is retried replaces itself, so every row
counts once. Derived relations are evaluated when they are read. Event-time windows come from
binding ``F.window`` columns as arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.operators.state import checkpoint_dir


class StreamedRelation:
    """``name``/len(keys) of a program, grown by a stream. ``aggregator`` folds rows of equal keys;
    for += the batches are pre-summed, for min= and max= pre-folded, so the folder stays small."""

    def __init__(self, program, name: str, keys: list[str], value: str, schema: str, aggregator: str = "+=", path: str | None = None):
        self.program, self.name, self.keys, self.value, self.aggregator = program, name, list(keys), value, aggregator
        self.schema = schema
        self.path = path or f"{checkpoint_dir(program.spark).rstrip('/')}/rulespark/stream-{name}"
        self.on_batch: list[Callable[[int], None]] = []
        self._bind()

    def _bind(self) -> None:
        spark = self.program.spark
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            fs.mkdirs(where)
        rows = spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        self.program.bind(self.name, rows, self.keys, self.value, aggregator=self.aggregator)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch, for ``foreachBatch``."""
        folds = {"+=": F.sum, "min=": F.min, "max=": F.max}
        rows = batch.select(*self.keys, self.value)
        if self.aggregator in folds:
            rows = rows.groupBy(*self.keys).agg(folds[self.aggregator](self.value).alias(self.value))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self._bind()
        for f in self.on_batch:
            f(batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **options):
        """Starts the query; ``options`` such as trigger keywords go to ``trigger``."""
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (writer.trigger(**options) if options else writer).start()
