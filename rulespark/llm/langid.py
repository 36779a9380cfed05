"""Operator 5: language identification with error-correcting output codes.

Every language gets a codeword of bits, far from all others; each bit has a binary
classifier over hashed byte n-grams. A classifier's weight of an n-gram is the log ratio of
the n-gram's rate in the languages whose bit is one and in those whose bit is zero, from
counts over all labelled documents (summed by tasks first, then over tasks; a table of
languages times ``DIMENSIONS``, whatever the corpus). A text's margin for a bit is the mean
weight of its n-grams. Decoding takes the codeword of least loss, each bit weighed by how
surely its classifier separates the languages; a document is flagged as ambiguous when the
second-best codeword is nearly as good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits

DIMENSIONS = 1 << 15
UNDETERMINED = "und"
#: Steepness of the loss in margins (mean log ratios).
STEEPNESS = 8.0
#: A score (share of the best codeword) below this flags a document.
AMBIGUOUS = 0.55
#: Bytes hashed at a time.
CHUNK = 1 << 16

#: Languages that one model tells apart, at most: it has 128 KiB of weights for each bit of a code.
LANGUAGES = 2000

_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed byte bigrams, trigrams and 4-grams of a text, ASCII letters lower-cased, each once,
    in chunks of those that start within ``CHUNK`` bytes."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8).astype(np.uint32)
    for at in range(0, len(data), CHUNK):
        b = data[at : at + CHUNK + 3]
        two = b[:-1] << 8 | b[1:]
        out = [two[:CHUNK] * np.uint32(2654435761) >> np.uint32(17)]
        if len(b) > 2:
            three = two[:-1] << 8 | b[2:]
            out.append(three[:CHUNK] * np.uint32(2246822519) >> np.uint32(17))
        if len(b) > 3:
            out.append((three[:-1] << 8 | b[3:])[:CHUNK] * np.uint32(3266489917) >> np.uint32(17))
        yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """``n`` codewords of +1 and -1, one a row: exhaustive for up to 6, else the best-spread of
    random codes of 10 log2 n bits, columns with both signs."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = [[1] * ((1 << (n - 1)) - 1)]
        for row in range(1, n):
            run = 1 << (n - 1 - row)
            bits.append([-1 if (k // run) % 2 == 0 else 1 for k in range((1 << (n - 1)) - 1)])
        return np.array(bits, np.int8)
    rng, best, spread = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(60):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        alike = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(alike, -length)
        apart = int(length - alike.max()) // 2
        if apart > spread and (abs(code.sum(axis=0)) < n).all():
            best, spread = code, apart
    return best


class LanguageModel:
    """``counts``: {language: counts of its hashed n-grams}."""

    def __init__(self, counts: dict[str, np.ndarray], docs: dict[str, int] | None = None):
        self.languages = sorted(counts)
        n = len(self.languages)
        self.code = codewords(n)
        if n < 2:
            return
        rates = np.stack([(counts[k] + 0.5) / (counts[k].sum() + 0.5 * DIMENSIONS) for k in self.languages])
        weights, sure = [], []
        for column in self.code.T:
            ones, zeros = rates[column > 0].mean(axis=0), rates[column < 0].mean(axis=0)
            w = np.log(ones / zeros)
            means = rates @ w
            # The bit's threshold lies between the nearest languages of either side.
            low, high = means[column < 0].max(), means[column > 0].min()
            weights.append(w - (low + high) / 2)
            sure.append(max((high - low) / 2, 1e-3))
        self.weights = np.stack(weights, axis=1).astype(np.float32)
        self.sure = np.minimum(np.array(sure) / max(sure), 1.0)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for codes in grams(text):
            total += self.weights.take(codes, axis=0).sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous). Equally near codewords: the first language by name, ambiguous."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.logaddexp(0, -STEEPNESS * self.code * self.margins(text)) @ self.sure
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(share.argmax())
        return self.languages[best], float(share[best]), bool(share[best] < AMBIGUOUS)


def fit(docs: DataFrame, train: Column) -> LanguageModel:
    """Counts over all rows of ``docs(text, lang, ...)`` where ``train`` holds and lang is not null.

    Null texts and texts without a letter teach nothing; a repeated row counts each time; a very
    long text is counted whole; a null ``train`` is false. Without any such row the model knows no
    language and calls every text undetermined. More than ``LANGUAGES`` languages raise ValueError.
    """
    spark = docs.sparkSession
    arrow_limits(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = counts.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                if has_letter(t := text.as_py()):
                    for codes in grams(t):
                        own += np.bincount(codes, minlength=DIMENSIONS)
        for lang, own in counts.items():
            (at,) = own.nonzero()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "gram", "n"]
            )

    rows = docs.where(F.coalesce(train, F.lit(False)) & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    summed = rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for batch in summed.toArrow().to_batches():
        langs = np.array(batch.column(0).to_pylist(), object)
        at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for lang in set(langs):
            own = langs == lang
            counts.setdefault(lang, np.zeros(DIMENSIONS, np.int64))[at[own]] += n[own]
    return LanguageModel(counts)


def predict(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str]) -> DataFrame:
    """``docs(text, ...)`` with three further columns: language, score, ambiguous.

    Null and empty texts and texts without a letter (Unicode category L) are undetermined, score
    0, ambiguous. Repeated rows and null ids each return; an empty table gives an empty one. Names
    that ``docs`` has already raise ValueError (``fresh`` finds others).
    """
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"one of {', '.join(names)} is a column already")
    held = docs.sparkSession.sparkContext.broadcast(model)
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            found = [held.value.predict(t.as_py()) for t in text]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            for name, column, kind in zip(names, columns, (pa.string(), pa.float64(), pa.bool_()), strict=True):
                batch = batch.append_column(name, pa.array(column, kind))
            yield batch

    schema = docs.schema
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.__class__(list(schema.fields)).add(name, kind)
    return docs.mapInArrow(run, schema)
