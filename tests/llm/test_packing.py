import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rulespark.llm import bestfit, packing, tokens

SCHEMA = "doc_id long, text string, piece string, length long, rank int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.resolve(tokens.TOKENIZER))


def texts():
    rnd = random.Random(3)
    odd = ["", None, " ", "a", "é ß\r\n\t x", "a<|endoftext|>b", "x" * 5000, "日本語" * 900, "1 2 3 don't I'll  "]
    return odd + [" ".join(rnd.choice(["the", "Über", "été", "42", "!!", "zqx"]) for _ in range(n)) for n in range(0, 4000, 97)]


def rows():
    out = [(i, t, "p", 7, 1) for i, t in enumerate(texts())]
    return out + out[20:24] + [(None, "no id", None, None, None)] * 2


def test_ids_are_those_of_tokenizers(tokenizer):
    encode = tokens.encoder()
    for t in texts():
        assert encode(t or "") == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_very_long_runs(tokenizer):
    encode = tokens.encoder()
    for t in [" " * 300_000 + "x", "a" + "\n\t" * 100_000, "a" * 200_000, "9" * 50_000, "!?" * 50_000, "é" * 50_000]:
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_run_in_tokenizers():
    name = "word_bpe_49k.json"
    whole = Tokenizer.from_file(tokens.resolve(name))
    assert tokens.encoder(name)("Hello World") == whole.encode("Hello World", add_special_tokens=False).ids


def test_pieces_and_places(spark, tokenizer):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = bestfit.pack(df).collect()
    wanted = Counter()
    for d, t, *_ in rows():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        parts = [(0, ids[:first])] + [(a, ids[a : a + 1024]) for a in range(first, len(ids), 1024)]
        for k, (a, part) in enumerate(parts):
            wanted[d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    for own in spots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(spots) <= -(-total // 1024) + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bestfit.pack(df).collect() == [] and packing.pack_matrices(df).collect() == []


def test_ranks_over_many_tasks(spark):
    df = spark.createDataFrame(rows() * 3, SCHEMA).repartition(7)
    written = bestfit.materialize(bestfit.pieces(df), "t")
    ranks = defaultdict(list)
    for r in bestfit.ranked(written).collect():
        ranks[r.length].append(r.rank)
    assert all(sorted(own) == list(range(len(own))) for own in ranks.values()) and len(ranks) > 3
    got = bestfit.pack(df).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_sequences_hold_the_ids(spark, tokenizer):
    df = spark.createDataFrame(rows(), SCHEMA)
    packed = bestfit.materialize(bestfit.pack(df, with_ids=True), "t")
    by_sequence = {r.sequence_id: r for r in bestfit.sequences(packed).collect()}
    for r in packed.collect():
        ids = by_sequence[r.sequence_id].ids
        assert zlib.crc32(ids[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(r)
            place(i + 1, [*rooms[:k], r - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_the_reduction_keeps_an_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    packer = bestfit.Packer(Counter(sizes), 20)
    fixed = packer.reduce()
    rest = sorted((s for s, n in packer.left.items() for _ in range(n)), reverse=True)
    assert fixed + optimum(rest, 20) == optimum(sizes, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), max_size=25))
def test_placements_cover_each_piece_once(counts):
    placements = bestfit.Packer(dict(counts), 60).pack()
    placed, fill = Counter(), defaultdict(list)
    for p in placements:
        placed[p.length] += p.bins * p.each
        for s in range(p.sequence, p.sequence + p.bins):
            fill[s] += [(p.offset + k * p.length, p.length) for k in range(p.each)]
    assert placed == Counter(counts)
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 60


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 33), max_size=60))
def test_capacity_tree_gives_the_best_fit(sizes):
    got = packing.best_fit_decreasing(sizes, 33)
    rooms, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        k = rooms.index(min(fits)) if fits else len(rooms)
        if not fits:
            rooms.append(33)
            want.append(0)
        rooms[k] -= sizes[i]
    assert sorted(33 - sum(sizes[i] for i in g) for g in got) == sorted(rooms)
    assert sorted(i for g in got for i in g) == list(range(len(sizes)))


def test_matrices_round_trip(spark, tokenizer):
    df = spark.createDataFrame(rows(), SCHEMA)
    matrices = packing.pack_matrices(df, shard_ids=3000)
    back = defaultdict(list)
    for r in packing.segments(matrices).collect():
        back[r.doc_id].append((r.piece, r.ids))
    texts_of = defaultdict(list)
    for d, t, *_ in rows():
        texts_of[d].append(t)
    for d, own in texts_of.items():
        if len(own) == 1:
            ids = np.frombuffer(b"".join(x for _, x in sorted(back[d])), "<u4").tolist()
            assert ids == [*tokenizer.encode(own[0] or "", add_special_tokens=False).ids, 2]
        else:
            assert len(back[d]) % len(own) == 0
    for m in matrices.collect():
        assert len(m.ids) == 4 * m.n_rows * m.width
        for n, ends, resets in zip(m.n_tokens, m.cu_seqlens, m.position_resets):
            assert ends[-1] == n <= m.width and resets == ends[:-1]
            positions = packing.position_ids(resets, n)
            assert [i for i, p in enumerate(positions) if p == 0] == resets


def test_position_ids():
    assert packing.position_ids([0, 3, 4], 6).tolist() == [0, 1, 2, 0, 0, 1]


def test_ranks_need_no_sort_of_the_pieces(spark):
    rows = spark.createDataFrame([(5, p, n) for p in range(3) for n in range(4)] + [(7, 1, 0)], "length long, part int, nth long")
    spread = bestfit.ranked(rows.repartition(4))
    assert sorted((r.length, r.rank) for r in spread.collect()) == [(5, k) for k in range(12)] + [(7, 0)]
    plan = spread._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan, plan
