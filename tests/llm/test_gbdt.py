import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rulespark.llm import gbdt


def walk(trees, x):
    """One row through one tree after the other."""
    out = []
    inner = trees.feature.shape[1]
    for row in x:
        total = trees.start
        for f, c, v in zip(trees.feature, trees.cut, trees.value, strict=True):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - inner]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_flat_trees_equal_a_walk_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(gbdt.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = gbdt.boost(x[:2000], y[:2000])
    scores = trees.scores(x[2000:])
    assert np.allclose(scores, walk(trees, x[2000:]))
    assert ((scores > 0.5) == y[2000:]).mean() > 0.95


def corpus(n=400):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(5, 150))]
        good = i % 3 > 0
        if not good:
            words = rnd.choice([[w.upper() + "!!" for w in words], [words[0]] * len(words), [w + " |" for w in words]])
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(good), 0))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, quality string, score double", "doc_id long, quality int, toxic int"


def test_held_out_quality(spark):
    rows, labels = corpus()
    odd = [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (None, "a b", None, None), (1002, "w " * 200_000, "x", 0.0)]
    df = spark.createDataFrame([*rows, *odd, rows[0]], DOCS)
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 0), (5000, 1, 0)], LABELS)
    got = {r.doc_id: r for r in gbdt.quality(df, marks.where(F.col("doc_id") % 4 != 0)).collect()}
    held = [i for i in range(0, 400, 4)]
    right = sum((got[i].score >= 0.5) == (i % 3 > 0) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and len(got) == 404


def test_the_fit_does_not_depend_on_row_order(spark):
    rows, labels = corpus(120)
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    a = gbdt.fit(df.repartition(3), marks, rows=80)
    b = gbdt.fit(df.orderBy(F.desc("doc_id")), marks.repartition(2), rows=80)
    assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)


def test_empty_and_one_class(spark):
    rows, labels = corpus(60)
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    assert gbdt.quality(df.limit(0), marks).collect() == []
    assert {r.score for r in gbdt.quality(df, marks.limit(0)).collect()} == {0.5}
    assert len({r.score for r in gbdt.quality(df, marks.where("quality = 1")).collect()}) == 1


def test_statistics_are_finite():
    for t in [None, "", " ", "a", "\n\n", "é" * 9, "A!" * 999, "a b " * 70_000]:
        assert len(gbdt.statistics(t)) == len(gbdt.FEATURES) and np.isfinite(gbdt.statistics(t)).all()


def repetition(words):
    """By definition: kinds of words, the top word, words like the last one and kinds of pairs, over the whole text."""
    pairs = list(zip(words, words[1:]))
    top = max(Counter(words).values())
    return [len(set(words)) / len(words) ** 0.75, top / len(words), sum(a == b for a, b in pairs) / max(1, len(pairs)), len(set(pairs)) / max(1, len(pairs))]


def test_repetition_is_that_of_the_whole_text():
    at = gbdt.FEATURES.index("distinct_words")
    rnd = random.Random(3)
    long = [f"w{rnd.randrange(30_000)}" for _ in range(65_537)]
    for words in [["a"], ["a", "a", "b"], long[:-1], long, long * 3]:
        assert np.allclose(gbdt.statistics(" ".join(words))[at : at + 4], repetition(words), rtol=1e-12)
    a, b = (gbdt.statistics(" ".join(w)) for w in (long[:-1], long))
    assert np.allclose(a, b, rtol=0.01)


def test_a_repeated_id_is_bounded(spark):
    """An id of many documents brings back no more rows than ``rows``; the fit does not depend on their order."""
    docs = spark.createDataFrame([(1, f"text {i % 50} " * (1 + i % 7)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    a, b = gbdt.fit(docs, labels, rows=60), gbdt.fit(docs.repartition(5), labels, rows=60)
    assert a.start == b.start and np.array_equal(a.value, b.value)
