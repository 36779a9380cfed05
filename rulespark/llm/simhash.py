"""Operator 3: SimHash near-duplicates with pigeonhole blocks.

A fingerprint of 64 bits is cut into five blocks. Two fingerprints that differ in at
most three bits leave at least two blocks alike, so they share one of the ten pairs of
blocks: those pairs are the join keys. Only distinct fingerprints are joined (copies
are one row), every bucket's candidates are verified by Hamming distance, and a bucket
returns a spanning forest of its links, which keeps connectivity without all pairs.
A bucket of more than ``BUCKET`` fingerprints is dealt again by its unequal bits with
13 sub-blocks, of which any three may differ; such a bucket holds at most 512
fingerprints, so no task grows with a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits, fresh, materialize
from rulespark.llm.graph import connected_components

WORDS_PER_SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Block widths, from the lowest bit.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
#: Fingerprints of one bucket that a task compares directly.
BUCKET = 4096
#: Shingles hashed before their bits are added up.
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for null and wordless texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - WORDS_PER_SHINGLE + 1)
    stops = ends[WORDS_PER_SHINGLE - 1 :].tolist() or [len(joined)]
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    # Marked so that no optimizer rule computes a text's fingerprint a second time.
    return simhash.asNondeterministic()(text)


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _keys(fp: Column) -> Column:
    """The ten block-pair keys: number of the pair, then both blocks."""
    return F.array(
        *(
            F.shiftleft(_block(fp, i), 13).bitwiseOR(_block(fp, j)).bitwiseOR(F.lit(k << 26))
            for k, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))
        )
    )


def _masks(pair: int) -> list[int]:
    """For a hot bucket of this block pair: the bits kept when three sub-blocks may differ."""
    fixed = list(combinations(range(len(WIDTHS)), 2))[pair]
    free = [SHIFTS[b] + o for b in range(len(WIDTHS)) if b not in fixed for o in range(WIDTHS[b])]
    parts = [free[i::13] for i in range(13)]
    every = (1 << 64) - 1
    return [every & ~sum(1 << b for p in three for b in p) for three in combinations(parts, DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (star to the first member) that join what is within ``DISTANCE`` bits, directly or by steps."""
    out = []
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(a, b)] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= DISTANCE else []
    rest = np.unique(fps).view(np.uint64)
    while len(rest) > 1:
        first, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= DISTANCE
            if near.any():
                met = rest[near]
                rest = rest[~near]
                frontier.extend(met)
                out.extend((int(first.view(np.int64)), int(x)) for x in met.view(np.int64))
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        found = [e for fps in frame["fps"] for e in forest(np.asarray(fps, np.int64))]
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def fingerprint_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct ``prints(fp)`` -> links ``(a, b)`` that connect what lies within three bits."""
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    crowded = materialize(sizes.where(F.col("n") > bucket).select("key"), "hot-buckets")
    small = keyed.join(crowded, "key", "left_anti").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    links = small.where(F.size("fps") > 1).select("fps").mapInPandas(_verify, "a long, b long")
    if crowded.isEmpty():
        return links
    masks = F.array(*(F.array(*(F.lit(_signed(m)) for m in _masks(p))) for p in range(10)))
    hot = keyed.join(crowded, "key", "left_semi")
    own = F.element_at(masks, (F.shiftright("key", 26) + 1).cast("int"))
    dealt = hot.select("key", "fp", F.posexplode(own).alias("at", "mask")).select(
        "fp", "key", "at", F.col("fp").bitwiseAND(F.col("mask")).alias("part")
    )
    again = dealt.groupBy("key", "at", "part").agg(F.collect_list("fp").alias("fps"))
    return links.union(again.where(F.size("fps") > 1).select("fps").mapInPandas(_verify, "a long, b long"))


def _grouped(rows: DataFrame, bucket: int) -> DataFrame:
    """``rows(doc_id, fp)`` -> ``(fp, root, component_id)`` of every distinct fingerprint."""
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(fingerprint_links(prints.select("fp"), bucket))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per row: doc_id, fingerprint, component_id.

    Null or wordless texts have fingerprint zero and link like any other. A null doc_id
    never names a component unless the component has no other; repeated rows each return.
    An empty table gives an empty one; further columns of ``docs`` are ignored.
    """
    arrow_limits(docs.sparkSession)
    rows = materialize(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp")), "simhash")
    groups = _grouped(rows, bucket)
    return rows.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest doc_id.

    All columns stay as they are. Null and wordless texts have fingerprint zero and are one
    component; a null doc_id stays only if its component has no other. Of rows that repeat the
    kept doc_id, the one with the smallest fingerprint, then text hash, stays, once. An empty
    table gives an empty one. Each text is fingerprinted once; what is joined back is ids. The
    texts move once, dealt by (doc_id, text hash), so that neither a large group nor null ids
    are one task; they meet a hash table of the ids kept and are never sorted.
    """
    arrow_limits(docs.sparkSession)
    (hashed,) = fresh(docs, "hash")
    text_hash = F.xxhash64(F.col("text"))
    rows = materialize(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp"), text_hash.alias("h")), "simhash")
    owners = rows.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("n")).join(_grouped(rows, bucket), "fp")
    mine = owners.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = mine.groupBy("root", "component_id").agg(F.min(F.struct("fp", "h", "n")).alias("k"))
    kept = materialize(
        first.select(F.col("component_id").alias("kept_id"), F.col("k.h").alias("kept_hash"), F.col("k.n").alias("kept_n")),
        "kept",
    )
    marked = docs.withColumn(hashed, text_hash)
    met = marked.join(
        kept.select("kept_id", "kept_hash").hint("shuffle_hash"),
        (marked[hashed] == kept["kept_hash"]) & marked["doc_id"].eqNullSafe(kept["kept_id"]),
        "left_semi",
    )
    if not kept.where("kept_n > 1").isEmpty():
        met = met.dropDuplicates(["doc_id", hashed])
    return met.select(docs.columns)
