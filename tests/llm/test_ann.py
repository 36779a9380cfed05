import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, id int"


def brute(ids, vectors, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def vectors(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24))
    x[n // 2 :] = x[rng.integers(0, 40, n - n // 2)] + 0.05 * rng.normal(size=(n - n // 2, 24))
    x[200:320] = x[100]  # copies of a query
    return np.arange(n), x.astype(np.float32)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist(), 0.0, 1) for i, v in zip(ids, x)], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"group": 7, "block": 500}])
def test_recall_against_brute_force(spark, options):
    ids, x = vectors()
    got = ann.nearest(frame(spark, ids, x), "vec_id", "embedding", F.col("id") % 100 == 0, **options).collect()
    want = brute(ids, x.astype(np.float64), range(0, 3000, 100))
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert set(found) == set(want) and all(len(v) == 10 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    assert [i for i, _ in found[100]] == [i for i, _ in want[100]]  # ties go to the smaller id
    for q, own in found.items():
        assert own == sorted(own, key=lambda p: (p[1], p[0]))
        for i, s in own:
            assert s == pytest.approx(np.sqrt(((x[i].astype(np.float64) - x[q].astype(np.float64)) ** 2).sum()), abs=1e-12)


def test_odd_vectors_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 0.0]), (100, [3.0, 0.0]), (200, [0.0, 0.0]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, "vec_id", "embedding", F.col("id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == [
        (0, 1, 6, 1.0), (0, 2, 100, 2.0), (100, 1, 0, 2.0), (100, 2, 6, round(5**0.5, 9)),
    ]


def test_repeated_rows_and_empty_tables(spark):
    ids, x = vectors(200)
    df = frame(spark, ids, x)
    twice = ann.nearest(df.union(df), "vec_id", "embedding", F.col("id") % 100 == 0).collect()
    once = ann.nearest(df, "vec_id", "embedding", F.col("id") % 100 == 0).collect()
    assert sorted(twice) == sorted(once)
    assert ann.nearest(df.limit(0), "vec_id", "embedding", F.col("id") % 100 == 0).collect() == []
