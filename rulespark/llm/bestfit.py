"""Operator 6: best-fit packing after Martello-Toth dominance reduction, over the whole corpus.

The instance is the histogram of piece lengths: at most ``capacity`` numbers, however many
documents there are, so it is solved exactly once on the driver. The reduction fixes sets
that provably dominate every alternative for their largest piece (alone, an exact pair, the
largest partner where only one fits, or a triple where at most two fit), for all pieces of
a length at once. Best-fit decreasing packs the rest, again a group of like sequences at a
time. What comes out are placements: ranges of ranks within a length -> sequence numbers
and offsets; the documents look theirs up by their rank, which is counted without gathering
a length in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits, materialize
from rulespark.llm.tokens import TOKENIZER, cuts, document_ids, encoder

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class Placement(NamedTuple):
    """``bins`` sequences from ``sequence`` on take ``each`` pieces of ``length`` from ``offset`` on."""

    length: int
    sequence: int
    bins: int
    each: int
    offset: int


class Packer:
    """Packs a histogram {length: count}; ``placements`` cover every piece once."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        if any(not 0 < size <= capacity for size in counts):
            raise ValueError("a piece is empty or longer than the capacity")
        self.capacity = capacity
        self.left = {size: n for size, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.placements: list[Placement] = []
        self.sequences = 0

    def _take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.remove(size)

    def _fix(self, pieces: tuple[int, ...], bins: int) -> None:
        """``bins`` sequences that each hold ``pieces``, closed for good."""
        at = 0
        for size in pieces:
            self.placements.append(Placement(size, self.sequences, bins, 1, at))
            self._take(size, bins)
            at += size
        self.sequences += bins

    def _largest(self, room: int, held: dict[int, int]) -> int | None:
        """The largest length of at most ``room`` of which more is left than ``held`` takes."""
        for i in range(bisect_left(self.sizes, room + 1) - 1, -1, -1):
            if self.left[self.sizes[i]] > held.get(self.sizes[i], 0):
                return self.sizes[i]
        return None

    def _smallest(self, k: int, big: int) -> list[int]:
        """The ``k`` smallest pieces besides one of ``big``."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(k - len(out), self.left[size] - (size == big))
            if len(out) == k:
                break
        return out

    def _dominating(self, big: int) -> tuple[int, ...] | None:
        """A set with ``big`` that dominates every feasible set with it, or None."""
        room = self.capacity - big
        first = self._largest(room, {big: 1})
        if first is None:
            return (big,)
        if first == room:
            return (big, first)
        low = self._smallest(3, big)
        if len(low) < 2 or low[0] + low[1] > room:
            return (big, first)
        if len(low) == 3 and sum(low) <= room:
            return None
        # At most two others fit. {first, second} dominates if no feasible pair has a
        # smaller member above second: then x fits into first's place and y into second's.
        held = {big: 1, first: 1} if first != big else {big: 2}
        second = self._largest(room - first, held)
        if second is None:
            return None
        y = self._largest(room // 2, {big: 1})
        above = [s for s in self.sizes if second < s <= (y or 0)]
        for s in above:
            partners = [p for p in self.sizes if s <= p <= room - s]
            if any(self.left[p] > (p == big) + (p == s) for p in partners):
                return None
        return (big, first, second)

    def reduce(self) -> int:
        """Fixes dominating sets, for the largest lengths first, until a pass over all lengths
        finds none; the number of sequences fixed. What dominates for one piece of a length
        does so for the next while both sets' lengths last, so a set is fixed in bulk."""
        before, changed = self.sequences, True
        while changed:
            changed, i = False, len(self.sizes) - 1
            while i >= 0:
                found = self._dominating(self.sizes[i])
                if found is None:
                    i -= 1
                else:
                    self._fix(found, min(self.left[s] // found.count(s) for s in set(found)))
                    changed, i = True, min(i, len(self.sizes) - 1)
        return self.sequences - before

    def best_fit(self) -> None:
        """Best-fit decreasing over what is left, like sequences together."""
        rooms: dict[int, list[tuple[int, int]]] = {}
        order: list[int] = []

        def put(room: int, first: int, bins: int) -> None:
            if room and bins:
                if room not in rooms:
                    rooms[room] = []
                    insort(order, room)
                rooms[room].append((first, bins))

        for size in reversed(list(self.sizes)):
            n = self.left[size]
            while n:
                at = bisect_left(order, size)
                if at < len(order):
                    room = order[at]
                    first, bins = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room], order[at]
                else:
                    room, first = self.capacity, self.sequences
                    bins = -(-n // (room // size))
                    self.sequences += bins
                each = min(room // size, n)
                used = min(bins, n // each)
                self.placements.append(Placement(size, first, used, each, self.capacity - room))
                put(room - each * size, first, used)
                put(room, first + used, bins - used)
                n -= used * each
            self._take(size, self.left[size])

    def pack(self) -> list[Placement]:
        self.reduce()
        self.best_fit()
        return self.placements


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> its pieces; ``with_ids`` adds the ids, little-endian uint32.

    ``part`` is the task's number and ``nth`` the place among the task's pieces of that length; they
    belong together once the pieces are written, since one attempt of a task is committed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = document_ids(text.as_py(), encode)
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    row = (doc_id, k, start, length, zlib.crc32(data), part, seen[length], data)
                    seen[length] += 1
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names[: len(out)])

    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def assign(rows: DataFrame, placements: list[Placement]) -> DataFrame:
    """``rows(..., length, rank)`` -> with sequence_id and offset. The placements are at most a
    few for each length and each change of room, so their number is bounded by the capacity."""
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    for size in {p.length for p in placements}:
        own = [p for p in placements if p.length == size]
        ends = np.cumsum([p.bins * p.each for p in own])
        by_length[size] = (ends, *(np.array([p[k] for p in own]) for k in (1, 2, 3, 4)))
    held = rows.sparkSession.sparkContext.broadcast(by_length)

    names = [f.name for f in rows.schema if f.name != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                ends, first, _, each, start = held.value[int(size)]
                k = np.searchsorted(ends, rank[at], side="right")
                within = rank[at] - np.where(k > 0, ends[k - 1], 0)
                sequence[at] = first[k] + within // each[k]
                offset[at] = start[k] + within % each[k] * size
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank")
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def ranked(rows: DataFrame) -> DataFrame:
    """Written pieces with ``rank``: 0, 1, ... within each length, by ``part`` and ``nth``. Pieces
    meet the counts of the parts before theirs by (length, part), so a frequent length is spread
    over as many keys as tasks that cut documents. The counts, one row a key, are hashed, so that
    no piece is sorted."""
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = [c for c in rows.columns if c not in ("part", "nth")]
    return rows.join(shifts.hint("shuffle_hash"), ["length", "part"]).select(*own, (F.col("nth") + F.col("shift")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece with its sequence_id and offset.

    A null text is an empty one and gives one piece, the end id. Repeated rows and null ids
    are packed like any other; an empty table gives an empty one. Further columns of
    ``docs`` are ignored. Of sequences with equal room the one opened last takes the next
    piece; pieces of equal length are interchangeable, so who gets which place is open.
    """
    rows = materialize(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    packer = Packer(counts, capacity)
    return assign(ranked(rows), packer.pack())


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces packed ``with_ids`` -> one row per sequence: ids (uint32), n_tokens, and the
    cumulative lengths of its pieces. A sequence holds at most the capacity, so do its rows."""

    def run(frames):
        for frame in frames:
            yield frame.assign(
                ids=[b"".join(x["ids"] for x in parts) for parts in frame["parts"]],
                ends=[np.cumsum([x["length"] for x in parts]).tolist() for parts in frame["parts"]],
            )[["sequence_id", "ids", "ends"]]

    grouped = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts")
    )
    return grouped.mapInPandas(run, "sequence_id long, ids binary, ends array<long>")
