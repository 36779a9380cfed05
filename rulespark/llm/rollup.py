"""Operator 2: token totals kept up to date by signed deltas.

A batch of changes is reduced to signed additive totals by (source, lang,
tokenizer_version) before anything is written: an insert adds, a delete takes away, and a
revision does both with the old and the new count. A batch is one Parquet folder named
by its id; an empty marker file, made after all else, commits it. Committing an id again
changes nothing, so a retried job cannot count twice. Totals are sums over the committed
folders. ``compact`` folds them into one batch of a new generation, which its own marker makes
current for every process that opens the folder; a generation left half-way is ignored. One
process writes at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits, filesystem
from rulespark.llm.tokens import TOKENIZER, encoder, resolve

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


@lru_cache(maxsize=4)
def version(tokenizer: str = TOKENIZER) -> str:
    """The vocabulary file's name and the start of its SHA-256."""
    with open(resolve(tokenizer), "rb") as file:
        digest = hashlib.file_digest(file, "sha256").hexdigest()
    return f"{PurePath(tokenizer).name}@{digest[:12]}"


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs(doc_id, text, source, lang, ...)`` -> doc_id, source, lang, tokenizer_version, n_tokens.

    Null and empty texts have no token; very long ones are counted whole. Null sources and
    languages stay null; repeated rows and null ids each return; an empty table gives an empty
    one. Further columns are ignored; a doc_id that is no whole number raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, own = encoder(tokenizer), version(tokenizer)
        for batch in batches:
            counts = [len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([own] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                ["doc_id", *KEYS, "n_tokens"],
            )

    arrow_limits(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("source", "lang", "text"))
    )
    return rows.mapInArrow(
        run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    )


def count_words(docs: DataFrame) -> DataFrame:
    """``docs`` -> the columns of ``count_tokens`` under the version "words": runs of non-blanks, a
    first estimate that needs no vocabulary."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x09-\x0D ]+"), ""))
    own = (F.col(c).cast("string").alias(c) for c in ("source", "lang"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own, F.lit("words").alias("tokenizer_version"), words.cast("long").alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


def _summed(deltas: DataFrame) -> DataFrame:
    """Keys whose totals are all zero go: that is what deleting all of a key's rows means."""
    totals = deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
    return totals.where(" or ".join(f"{c} <> 0" for c in SUMS))


class TokenRollup:
    """Totals at ``path``, a folder in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, path: str) -> list[str]:
        fs, where = filesystem(self.spark, path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _mark(self, path: str) -> None:
        fs, where = filesystem(self.spark, path)
        fs.create(where, True).close()

    def _generation(self) -> int:
        """The newest whole generation; 0 needs no marker."""
        found = [n.removeprefix("whole=") for n in self._names(self.path) if n.startswith("whole=")]
        return max(map(int, found), default=0)

    def _folder(self) -> str:
        return f"{self.path}/generation={self._generation()}"

    @staticmethod
    def _checked(batch_id: str) -> str:
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch_id!r}")
        return batch_id

    def _write(self, folder: str, batch_id: str, deltas: DataFrame) -> None:
        """A try that fails leaves files that no marker names; the next one has a folder of its own."""
        name = f"{batch_id}~{uuid.uuid4().hex}"
        _summed(deltas.select(*KEYS, *SUMS)).write.parquet(f"{folder}/data/{name}")
        self._mark(f"{folder}/committed/{name}")

    def _committed(self) -> dict[str, str | None]:
        """Batch id -> the folder of its rows; None if they are folded into another batch's."""
        folder = self._folder()
        out: dict[str, str | None] = {n: None for n in self._names(f"{folder}/folded")}
        return out | {n.split("~")[0]: f"{folder}/data/{n}" for n in self._names(f"{folder}/committed")}

    def committed(self) -> list[str]:
        return sorted(self._committed())

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed rows; False if that id is there already. An empty batch counts as one."""
        if self._checked(batch_id) in self._committed():
            return False
        self._write(self._folder(), batch_id, deltas)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens. Nulls are keys of their own."""
        paths = sorted(p for p in self._committed().values() if p)
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        return _summed(self.spark.read.schema(DELTA).parquet(*paths))

    def compact(self, batch_id: str) -> None:
        """Folds all batches into ``batch_id`` of the next generation, then makes that current.

        The ids folded stay remembered, so a late retry is still ignored. The old generation
        stays for readers that have begun; the one before it goes."""
        ids, now = self.committed(), self._generation()
        folder = f"{self.path}/generation={now + 1}"
        fs, where = filesystem(self.spark, folder)
        fs.delete(where, True)  # of a compaction that did not end
        self._write(folder, self._checked(batch_id), self.totals())
        for old in ids:
            self._mark(f"{folder}/folded/{old}")
        self._mark(f"{self.path}/whole={now + 1}")
        fs, where = filesystem(self.spark, f"{self.path}/generation={now - 1}")
        fs.delete(where, True)
