"""Operator 7: benchmark decontamination with suffix arrays over shards of training text.

Each task cuts its documents into shards, builds a suffix array of every shard's words and
binary-searches all suffixes of the benchmark items in it. The interval of the array that
agrees with a suffix on a whole window gives the places of that window; comparing on gives
the longest verbatim match. Suffixes that cannot hold a window - those with a word that no
item has among their first words - are left out of the array, which loses nothing.

Nothing is shuffled: a document's answer comes from the task that reads it. The benchmark
goes to the tasks in groups of at most ``GROUP_WORDS`` words, whatever its size; with more
than one group, the documents pass the groups one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits, fresh

#: Words of a window. An item of fewer words is one window.
WINDOW = 8
#: Items found in a document that make it contaminated.
ITEMS = 2
#: Bytes of benchmark text in one group, about, which bounds the broadcast.
GROUP_BYTES = 4 << 20
#: Words in one shard's array.
SHARD_WORDS = 1 << 19

_WORD = frozenset((*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased, and of characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Benchmark:
    """One group of items, ready to be searched for. Picklable; of bounded size."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        texts: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text))
            if ids and item is not None:
                texts.setdefault(ids, set()).add(item)
        self.longest = max(map(len, texts), default=0)
        self.shortest = min(window, min(map(len, texts), default=window))
        #: All items, each followed by -2; the suffixes that hold a window start in here.
        flat: list[int] = []
        self.names: list[int] = []
        firsts: list[int] = []
        windows: dict[tuple[int, ...], tuple[set[int], list[int]]] = {}
        for ids, names in texts.items():
            w = min(window, len(ids))
            for at in range(len(ids) - w + 1):
                owners, starts = windows.setdefault(ids[at : at + w], (set(), []))
                owners.update(names)
                starts.append(len(flat) + at)
            firsts.append(len(flat))
            self.names.append(min(names))
            flat += [*ids, -2]
        self.flat = np.array(flat, np.int32)
        #: Where each text starts in ``flat``, and the smallest of its items.
        self.firsts = np.array(firsts, np.int64)
        self.need = np.array([len(k) for k in windows], np.int64)
        self.tests = np.array([[*k, *[-2] * (window - len(k))] for k in windows], np.int32).reshape(-1, window)
        self.owners = [sorted(x[0]) for x in windows.values()]
        self.starts = [np.array(x[1], np.int64) for x in windows.values()]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order of their first ``depth`` words, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def _bound(text: np.ndarray, order: np.ndarray, tests: np.ndarray, depth: np.ndarray, right: bool) -> np.ndarray:
    """For each test: the first place in ``order`` whose suffix is not below it (``right``: is
    above it) on its first ``depth`` words. ``text`` is padded by the tests' width."""
    low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(order), np.int64)
    width = np.arange(tests.shape[1])
    within = width < depth[:, None]
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        there = text[order[mid][:, None] + width]
        differs = (there != tests[open_]) & within[open_]
        first = differs.argmax(axis=1)
        row = np.arange(len(open_))
        any_ = differs[row, first]
        below = any_ & (there[row, first] < tests[open_][row, first])
        up = below | (~any_ if right else False)
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]
    return low


def search(text: np.ndarray, group: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in ``text`` (word ids, -1 for words of no item): the place and the number of the window."""
    none = np.empty(0, np.int64)
    if not len(text) or not len(group.tests):
        return none, none
    # Starts of at least ``shortest`` known words in a row: ``ahead`` is the next unknown word.
    stops = np.append(np.flatnonzero(text < 0), len(text))
    ahead = stops[np.searchsorted(stops, np.arange(len(text)))]
    starts = np.flatnonzero(ahead - np.arange(len(text)) >= group.shortest)
    if not len(starts):
        return none, none
    # What lies outside the runs that hold such starts cannot match: it shrinks to one stop.
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ahead[starts], -1)
    keep = np.cumsum(mark) > 0
    keep[1:] |= keep[:-1]
    places = np.flatnonzero(keep[: len(text)])
    short = text[places]
    order = suffix_array(short, group.window)
    order = order[short[order] >= 0]
    padded = np.concatenate((short, np.full(group.window, -1, short.dtype)))
    low = _bound(padded, order, group.tests, group.need, False)
    counts = _bound(padded, order, group.tests, group.need, True) - low
    which = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return places[order[np.repeat(low, counts) + inside]], which


def extents(text: np.ndarray, place: np.ndarray, which: np.ndarray, group: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(how many words agree from each occurrence on, the item that agrees longest, the smallest of such)."""
    longest, item = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    pad = 16
    text = np.concatenate((text, np.full(pad, -1, text.dtype)))
    flat = np.concatenate((group.flat, np.full(pad, -2, group.flat.dtype)))
    many, names = np.array([len(x) for x in group.starts]), np.array(group.names, np.int64)
    for first in range(0, len(place), 1 << 14):
        own = np.arange(first, min(len(place), first + (1 << 14)))
        row = np.repeat(own, many[which[own]])
        starts = np.concatenate([group.starts[w] for w in which[own]])
        length = group.need[which[row]].copy()
        on = np.arange(len(row))
        while len(on):
            a, b = place[row[on]] + length[on], starts[on] + length[on]
            same = text[a[:, None] + np.arange(pad)] == flat[b[:, None] + np.arange(pad)]
            run = np.where(same.all(axis=1), pad, same.argmin(axis=1))
            length[on] += run
            on = on[run == pad]
        by = names[np.searchsorted(group.firsts, starts, side="right") - 1]
        order = np.lexsort((by, -length, row))
        best = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
        longest[row[best]], item[row[best]] = length[best], by[best]
    return longest, item


class _Document:
    """What is known of one document while its shards are searched."""

    __slots__ = ("row", "n_words", "spans", "items", "longest", "where", "item")

    def __init__(self, row, n_words, spans, items, longest, where, item):
        self.row, self.n_words, self.spans, self.items = row, n_words, spans, items
        self.longest, self.where, self.item = longest, where, item


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search_shard(parts: list[tuple[_Document, int, np.ndarray]], group: Benchmark) -> None:
    """``parts``: (document, place of the part's first word, word ids) of one shard."""
    ids = np.concatenate(list(chain.from_iterable((p[2], [-1]) for p in parts))).astype(np.int32)
    lengths = np.array([len(p[2]) + 1 for p in parts])
    firsts = np.cumsum(lengths) - lengths
    place, which = search(ids, group)
    longest, item = extents(ids, place, which, group)
    part = np.searchsorted(firsts, place, side="right") - 1
    by_part = np.argsort(part, kind="stable")
    for own in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1) if len(part) else []:
        doc, first, _ = parts[part[own[0]]]
        at = place[own] - firsts[part[own[0]]] + first
        doc.spans = _merge([*doc.spans, *zip(at.tolist(), (at + group.need[which[own]]).tolist(), strict=True)])
        for w in np.unique(which[own]).tolist():
            doc.items.update(group.owners[w])
        best = np.lexsort((item[own], at, -longest[own]))[0]
        met = (-int(longest[own[best]]), int(at[best]), int(item[own[best]]))
        if not doc.longest or met < (-doc.longest, doc.where, doc.item):
            doc.longest, doc.where, doc.item = -met[0], met[1], met[2]


def _searched(documents: Iterator[tuple[_Document, str | None]], group: Benchmark, shard_words: int) -> Iterator[_Document]:
    """Yields the documents in their order, each after its last shard."""
    lookup, overlap = group.vocabulary.get, max(group.longest, group.window) - 1
    parts: list[tuple[_Document, int, np.ndarray]] = []
    waiting: list[_Document] = []
    held = 0
    for doc, text in documents:
        own = words(text)
        doc.n_words = len(own)
        ids = np.fromiter((lookup(w, -1) for w in own), np.int32, len(own))
        step = max(shard_words, overlap + 1)
        for at in range(0, max(len(ids), 1), step):
            part = ids[at : at + step + overlap]
            if len(part):
                parts.append((doc, at, part))
                held += len(part)
            if held >= shard_words:
                _search_shard(parts, group)
                parts, held = [], 0
        waiting.append(doc)
        if not parts:
            yield from waiting
            waiting = []
    if parts:
        _search_shard(parts, group)
    yield from waiting


def _groups(benchmark: DataFrame, group_bytes: int, window: int) -> Iterator[Benchmark]:
    """The items in groups of bounded size, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // group_bytes) or 1
    for g in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g)
        yield Benchmark([(r["item_id"], r["text"]) for r in own.collect()], window)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, dict[str, str]]:
    """``docs(text, ...)`` -> its rows with further columns, and those columns' names by role:
    n_words, n_hit (words inside a window's occurrence), items (sorted ids), longest (words of
    the longest verbatim match of at least a window), longest_at (its first word; -1: none) and
    longest_item (the item that it is in; null: none). Of equally long matches the first counts,
    of items with the same one the smallest.

    Null texts have no words; null and repeated item_ids count as no item and as one; equal
    items are both found. An empty benchmark hits nothing. Names do not clash with columns of
    ``docs``. An item is never split over groups.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    roles = ("n_words", "spans", "items", "longest", "longest_at", "longest_item")
    names = dict(zip(roles, fresh(docs, *roles), strict=True))
    out = docs.withColumns(
        {
            names["n_words"]: F.lit(0).cast("long"),
            names["spans"]: F.array().cast("array<long>"),
            names["items"]: F.array().cast("array<long>"),
            names["longest"]: F.lit(0).cast("long"),
            names["longest_at"]: F.lit(-1).cast("long"),
            names["longest_item"]: F.lit(None).cast("long"),
        }
    )
    for group in _groups(benchmark, group_bytes, window):
        held = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            group, kinds = held.value, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 3]
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                n, spans, items, longest, where, item = (
                    batch.column(batch.schema.get_field_index(names[r])).to_pylist() for r in roles
                )
                found = (
                    _Document(i, n[i], list(zip(spans[i][::2], spans[i][1::2], strict=True)), set(items[i]), longest[i], where[i], item[i])
                    for i in range(batch.num_rows)
                )
                done = list(_searched(((d, text[d.row].as_py()) for d in found), group, shard_words))
                values = [
                    [d.n_words for d in done],
                    [list(chain.from_iterable(d.spans)) for d in done],
                    [sorted(d.items) for d in done],
                    [d.longest for d in done],
                    [d.where for d in done],
                    [d.item for d in done],
                ]
                for role, column, kind in zip(roles, values, kinds, strict=True):
                    at = batch.schema.get_field_index(names[role])
                    batch = batch.set_column(at, names[role], pa.array(column, kind))
                yield batch

        out = out.mapInArrow(run, out.schema)
    return out, names


def report(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    longest_match, longest_at, longest_item (see ``matches``)."""
    found, names = matches(docs.select("doc_id", "text"), benchmark, **options)
    spans, ids = F.col(names["spans"]), F.col(names["items"])
    steps = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    text = F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col(names["n_words"]).alias("n_words"),
        F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(text, 256).alias("items_sha256"),
        (F.size(ids) >= items).alias("contaminated"),
        F.col(names["longest"]).alias("longest_match"),
        F.col(names["longest_at"]).alias("longest_at"),
        F.col(names["longest_item"]).alias("longest_item"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS, **options) -> DataFrame:
    """``docs`` without the documents in which at least ``items`` items occur; columns as they are."""
    found, names = matches(docs, benchmark, **options)
    return found.where(F.size(names["items"]) < items).select(docs.columns)
