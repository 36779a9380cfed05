"""Operator 1: token ids packed into fixed-width matrices.

Each task packs its own documents, at most ``SHARD_IDS`` ids at a time: best-fit decreasing,
with a segment tree over residual capacities that finds the fullest sequence with room.
Overlong documents are split losslessly. A matrix row is one sequence; beside the ids come
the cumulative segment lengths of each sequence and the offsets where positions restart.
Nothing is shuffled; a shard leaves at most a few sequences part-filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits
from rulespark.llm.tokens import END, TOKENIZER, cuts, document_ids, encoder

CAPACITY = 1024
#: Ids that one shard packs together.
SHARD_IDS = 4 << 20
#: Sequences in one matrix.
MATRIX_ROWS = 64

MATRICES = (
    "shard string, matrix int, n_rows int, width int, ids binary, n_tokens array<int>, "
    "cu_seqlens array<array<int>>, position_resets array<array<int>>, "
    "doc_ids array<array<long>>, pieces array<array<int>>"
)


class CapacityTree:
    """Sequences by residual capacity; finds the least residual that still has room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least ``size``, removed; None if none has it."""
        node = size + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: go up until there is a right sibling
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # went past the last node of a level
                return None
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.held[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The item numbers of each sequence, in the order of their places."""
    tree, out = CapacityTree(capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        if found is None:
            room, sequence = capacity, len(out)
            out.append([])
        else:
            room, sequence = found
        out[sequence].append(item)
        if room > sizes[item]:
            tree.put(room - sizes[item], sequence)
    return out


def _matrices(parts: list[tuple], shard: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """``parts``: (doc_id, piece, ids) of one shard."""
    packed = best_fit_decreasing([len(p[2]) for p in parts], capacity)
    for k in range(0, len(packed), MATRIX_ROWS):
        rows = packed[k : k + MATRIX_ROWS]
        ids = np.full((len(rows), capacity), END, "<u4")
        ends = []
        for r, items in enumerate(rows):
            at = np.cumsum([0, *(len(parts[i][2]) for i in items)])
            for i, a, b in zip(items, at[:-1], at[1:], strict=True):
                ids[r, a:b] = parts[i][2]
            ends.append(at.tolist())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard]),
                pa.array([k // MATRIX_ROWS], pa.int32()),
                pa.array([len(rows)], pa.int32()),
                pa.array([capacity], pa.int32()),
                pa.array([ids.tobytes()], pa.binary()),
                pa.array([[e[-1] for e in ends]], pa.list_(pa.int32())),
                pa.array([ends], pa.list_(pa.list_(pa.int32()))),
                pa.array([[e[:-1] for e in ends]], pa.list_(pa.list_(pa.int32()))),
                pa.array([[[parts[i][0] for i in items] for items in rows]], pa.list_(pa.list_(pa.int64()))),
                pa.array([[[parts[i][1] for i in items] for items in rows]], pa.list_(pa.list_(pa.int32()))),
            ],
            ["shard", "matrix", "n_rows", "width", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "pieces"],
        )


def pack_matrices(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> matrices of up to 64 sequences (see ``MATRICES``).

    ``ids`` is row-major little-endian uint32, padded with the end id from ``n_tokens`` on.
    A null text is an empty one: the end id alone. Null and repeated doc_ids are packed like
    any other; an empty table gives no matrix. Further columns of ``docs`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        parts: list[tuple] = []
        held = shard = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = document_ids(text.as_py(), encode)
                parts += [(doc_id, k, ids[a : a + n]) for k, (a, n) in enumerate(cuts(len(ids), capacity))]
                held += len(ids)
                if held >= shard_ids:
                    yield from _matrices(parts, f"{task}-{shard}", capacity)
                    parts, held, shard = [], 0, shard + 1
        if parts:
            yield from _matrices(parts, f"{task}-{shard}", capacity)

    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, MATRICES)


def segments(matrices: DataFrame) -> DataFrame:
    """Matrices -> their segments (doc_id, piece, ids as uint32 bytes): the packing undone."""

    def run(frames):
        for batch in frames:
            rows = batch.select(["ids", "width", "cu_seqlens", "doc_ids", "pieces"]).to_pylist()
            out = [
                (d, p, x["ids"][4 * (r * x["width"] + a) : 4 * (r * x["width"] + b)])
                for x in rows
                for r, (ends, docs, pieces) in enumerate(zip(x["cu_seqlens"], x["doc_ids"], x["pieces"], strict=True))
                for a, b, d, p in zip(ends[:-1], ends[1:], docs, pieces, strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            kinds = [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "ids"]
            )

    return matrices.mapInArrow(run, "doc_id long, piece int, ids binary")


def position_ids(resets: list[int], n_tokens: int) -> np.ndarray:
    """Positions of one sequence, restarting at each reset."""
    starts = np.zeros(n_tokens, np.int64)
    starts[resets] = resets
    return np.arange(n_tokens) - np.maximum.accumulate(starts)
