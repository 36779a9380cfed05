"""Operator 9: document quality by histogram gradient-boosted trees.

Statistics of a whole text (shape of words and lines, repetition, symbols, entropy) are
binned at quantiles; boosting grows trees leaf-depth by leaf-depth on gradient histograms.
The fitted trees are flattened into arrays and walked by numpy for a whole batch at once.
Training takes at most ``TRAIN_ROWS`` labelled rows, those of the smallest hash of the id;
everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_IN_LEAF = 20
PENALTY = 1.0
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "mean_word", "sd_word", "upper", "digits", "spaces", "punctuation", "symbols", "beyond_ascii",
    "distinct_words", "top_word", "same_as_last", "distinct_pairs", "lines", "distinct_lines", "words_per_line", "bars",
    "marked_words", "stops", "entropy", "compressed",
)

_UPPER, _DIGIT = re.compile(r"[A-Z]+"), re.compile(r"[0-9]+")


def _counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)


def statistics(text: str | None) -> list[float]:
    """One value for each of ``FEATURES``; of an empty text all are zero."""
    text = text or ""
    n = len(text)
    words = text.split()
    if not words:
        return [log(1 + n)] + [0.0] * (len(FEATURES) - 1)
    by_byte = _counts(text)
    size = int(by_byte.sum())
    ascii_ = by_byte[:128]
    rate = by_byte[by_byte > 0] / size
    entropy = float(-(rate * np.log2(rate)).sum())
    letters = int(ascii_[65:91].sum() + ascii_[97:123].sum())
    upper, digits = int(ascii_[65:91].sum()), int(ascii_[48:58].sum())
    spaces = int(ascii_[[9, 10, 11, 12, 13, 32]].sum())
    stops = int(ascii_[[33, 44, 46, 58, 59, 63]].sum())
    symbols = int(ascii_[33:].sum()) - letters - digits - stops
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # Words and pairs are counted by number over the whole text: 8 bytes a word, however long it is.
    number: dict[str, int] = {}
    own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    few = max(1, len(own) - 1)
    same = int((own[1:] == own[:-1]).sum())
    pairs = len(np.unique(own[:-1] * len(number) + own[1:]))
    # Repetition is set against what a text of that length has: n words have about n^0.75 kinds.
    repeated = [len(number) / len(own) ** 0.75, int(np.bincount(own).max()) / len(own), same / few, pairs / few]
    lines = text.split("\n")
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words)
    raw = text.encode("utf-8", "surrogatepass")
    packed = zlib.compressobj(1)
    small = sum(len(packed.compress(raw[i : i + (1 << 20)])) for i in range(0, len(raw), 1 << 20)) + len(packed.flush())
    return [
        log(1 + n),
        log(1 + len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        upper / max(letters, 1),
        digits / size,
        spaces / size,
        stops / size,
        symbols / size,
        1 - int(ascii_.sum()) / size,
        *repeated,
        log(1 + len(lines)),
        len(set(lines)) / len(lines),
        log(len(words) / len(lines)),
        int(ascii_[124]) / len(words),
        marked / len(words),
        stops / len(words),
        entropy,
        small / size * (1 + 20 / log2(2 + size)),
    ]


class Trees:
    """Complete binary trees in flat arrays: node i's children are 2i+1 and 2i+2."""

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.cut, self.value = start, feature, cut, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of raw statistics."""
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            total += self.value[t, node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Second-order boosting of the logistic loss. One class, or no row, gives a constant."""
    n, width = x.shape if x.size else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1)
    start = log(share / (1 - share))
    inner = (1 << depth) - 1
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n < 2 * LEAST_IN_LEAF or y.min() == y.max():
        return Trees(start, feature[:0], cut[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    offset = binned + np.arange(width) * BINS
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * BINS) + offset).ravel()
            shape = (many, width, BINS)
            sums = [np.bincount(at, np.repeat(v, width), many * width * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            gl, hl, nl = (s[:, :, :-1] for s in sums)
            ga, ha, na = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + PENALTY) + (ga - gl) ** 2 / (ha - hl + PENALTY) - ga**2 / (ha + PENALTY)
            gain[(nl < LEAST_IN_LEAF) | (na - nl < LEAST_IN_LEAF)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = -RATE * gs / (hs + PENALTY)
        total += value[t, leaf]
    return Trees(start, feature, cut, value)


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality, ...)`` -> trees.

    At most ``rows`` labels, of the smallest hashes of their ids, go to the documents, which bounds
    what is broadcast; of the documents they meet (an id may repeat) at most ``rows``, of the
    smallest hashes of id and text, come back. Null ids and labels are left out; no label at all
    gives a constant. Empty and null texts train like any other."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(t.as_py() for t in batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(values.tolist(), pa.list_(pa.float64()))], ["quality", "h", "x"]
            )

    wanted = (
        labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
        .where("label_id is not null and quality is not null")
        .orderBy(F.xxhash64("label_id"), "label_id", "quality")
        .limit(rows)
    )
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labelled = own.join(F.broadcast(wanted), own["doc_id"] == wanted["label_id"])
    hashed = labelled.select("text", "quality", F.xxhash64("doc_id", "text").alias("h"))
    got = hashed.mapInArrow(run, "quality int, h long, x array<double>").orderBy("h", "quality").limit(rows).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = np.array(got.column("quality").to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order in which tasks end
    return boost(x[order], y[order])


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, score, one row per row: repeated rows and null ids too.

    Null texts score as empty ones do; a very long text is read whole; further columns are ignored,
    and an empty table gives an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(trees)
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.scores(_matrix(t.as_py() for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, score, predicted.

    A document labelled twice trains twice; empty and null texts have a score like any other;
    with labels of one class, or none, every score is the smoothed share of label 1.
    """
    return score(docs, fit(docs, labels, rows)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
