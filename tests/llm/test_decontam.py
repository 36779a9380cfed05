import hashlib
import random
import re

import numpy as np
import pytest

from rulespark.llm import decontam

DOCS = "doc_id long, text string, n_words string, spans string, items long, _items int"


def brute_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, met, longest = brute_words(text), set(), set(), 0
        for item, t in items:
            w = brute_words(t)
            n = min(8, len(w))
            if not n or item is None:
                continue
            for a in range(len(w) - n + 1):
                for p in range(len(own) - n + 1):
                    if own[p : p + n] == w[a : a + n]:
                        hit.update(range(p, p + n))
                        met.add(item)
                        k = n
                        while a + k < len(w) and p + k < len(own) and own[p + k] == w[a + k]:
                            k += 1
                        longest = max(longest, k)
        sha = hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(met), sha, len(met) >= 2, longest))
    return sorted(out, key=str)


def case(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "É", "x_y", "a-b"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([3, 7, 8, 9, 20, 45]))) for i in range(24)]
    items += [(100, items[5][1]), (101, "a b c d e f g h i"), (5, items[5][1]), (102, ""), (103, None), (None, text(9)), (104, "same " * 30)]
    docs = [(1000, None), (1001, ""), (1002, "!!"), (1003, "same " * 100), (1004, "A B, c d E f g h i")]
    for d in range(60):
        parts = [text(rnd.randrange(30))]
        for _ in range(rnd.randrange(4)):
            own = brute_words(rnd.choice(items)[1])
            a = rnd.randrange(len(own) + 1)
            parts += [" ".join(own[a : a + rnd.randrange(5, 40)]), text(rnd.randrange(6))]
        docs.append((d, " ".join(parts).upper() if d % 7 == 0 else " ".join(parts)))
    docs.append((2000, text(500) + " " + items[4][1] + " " + text(300) + items[9][1]))
    return docs + docs[10:12] + [(None, items[4][1])], items


@pytest.mark.parametrize("options", [{}, {"shard_words": 9}, {"shard_words": 100, "group_bytes": 700}])
def test_matches_brute_force(spark, options):
    docs, items = case(1)
    df = spark.createDataFrame([(d, t, "x", "y", 1, 2) for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(df, bench, **options).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == brute(docs, items)
    kept = decontam.remove(df, bench, **options)
    assert kept.columns == df.columns
    clean = sorted(((r[0]) for r in brute(docs, items) if not r[5]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == clean


def test_longest_match_is_located(spark):
    df = spark.createDataFrame([(1, "q q a b c d e f g h i j k q")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "z a b c d e f g h i j k y")], "item_id long, text string")
    row = decontam.report(df, bench).first()
    assert (row.longest_match, row.longest_at, row.longest_item, row.n_hit) == (11, 2, 1, 11)


def test_ties_of_the_longest_match(spark):
    nine, eight = "a b c d e f g h i", "r s t u v w x y"
    df = spark.createDataFrame([(1, f"{eight} q {nine} q {nine}"), (2, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, nine), (3, f"{nine} z"), (1, eight)], "item_id long, text string")
    got = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item) for r in decontam.report(df, bench).collect()}
    assert got == {1: (9, 9, 3), 2: (0, -1, None)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(docs, bench).first().n_items == 0
    assert decontam.report(docs.limit(0), bench).collect() == []


def test_suffix_array_orders_by_depth():
    rnd = np.random.default_rng(4)
    text = rnd.integers(0, 3, 300)
    order = decontam.suffix_array(text, 8)
    keys = [text[i : i + 8].tolist() for i in order]
    assert sorted(order) == list(range(300)) and keys == sorted(keys)
