import random

import xxhash

from rulespark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, _fp string"


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rnd = random.Random(5)
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one TWO"), (None, "a b c d"), (905, "É é É")]
    for g in range(6):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([20, 150, 700]))]
        for k in range(25):
            own = list(words)
            for _ in range(k % 5):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(9)}"
            rows.append((g * 100 + k, " ".join(own)))
    return rows + rows[30:35]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", None) for d, t in rows], SCHEMA)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    assert got(simhash.near_duplicates(frame(spark, rows))) == brute_components(rows)


def test_hot_buckets_are_dealt_again_without_losing_links(spark):
    rows = corpus()
    assert got(simhash.near_duplicates(frame(spark, rows), bucket=2)) == brute_components(rows)


def test_empty_table(spark):
    assert got(simhash.near_duplicates(frame(spark, []))) == []
    assert simhash.keep_one(frame(spark, [])).columns == ["doc_id", "text", "fp", "_fp"]


def test_keep_one_keeps_one_row_of_each_component(spark):
    rows = corpus()
    kept = simhash.keep_one(frame(spark, rows)).collect()
    wanted = {c for _, _, c in brute_components(rows)}
    assert sorted((r.doc_id for r in kept), key=str) == sorted(wanted, key=str)
    assert kept[0].fp == "x"


def test_long_text_is_hashed_whole():
    text = " ".join(str(i % 977) for i in range(100_000))
    assert simhash.fingerprint(text) == (lambda u: u - (1 << 64) if u >> 63 else u)(brute_print(text))
