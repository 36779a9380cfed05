"""Every registered op<N> query over the smallest tables, held against plain Python."""

import binascii
import struct
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from rulespark.llm import decontam, html_extract, langid, pii, queries, simhash, tokens
from rulespark.llm.rollup import version

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the sample tables are not here")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def get(name):
        if name not in held:
            held[name] = queries.queries()[name](spark, DATA).collect()
        return held[name]

    return get


def fold(doc_id, n):
    return binascii.crc32(str(doc_id).encode()) % n


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_op1(run, docs):
    encode, got = tokens.encoder(), Counter()
    for r in run("op1_token_matrices"):
        for row in range(r.n_rows):
            got[struct.unpack_from(f"<{r.n_tokens[row]}I", r.ids, 4 * row * r.width)] += 1
    total = sum(len(ids) * n for ids, n in got.items())
    assert total == sum(len(encode(d["text"] or "")) + 1 for d in docs)


def test_op2(run, docs):
    encode, want = tokens.encoder(), defaultdict(lambda: [0, 0])
    for d in docs:
        own = want[d["source"], d["lang"], version()]
        own[0] += 1
        own[1] += len(encode(d["text"] or ""))
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in run("op2_token_counts")}
    assert got == dict(want)


def test_op3(run, docs):
    prints = [(d["doc_id"], simhash.fingerprint(d["text"]) & ((1 << 64) - 1)) for d in docs]
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted((i, f"{fp:016x}", find(i)) for i, fp in prints)
    assert sorted(tuple(r) for r in run("op3_simhash_near_dedup")) == want


def test_op4(run):
    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    rows = [r for r in rows if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    found = defaultdict(list)
    for r in sorted(run("op4_nearest_neighbours")):
        found[r.query_id].append(r)
    hits = 0
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    for q, own in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        near = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits += len({r.vec_id for r in own} & set(near))
        assert [r.rank for r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r.score, r.vec_id))
        for r in own:
            assert r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12)
    assert hits >= 0.9 * 10 * len(found)


def test_op5(run, docs):
    by_id, got = {d["doc_id"]: d for d in docs}, run("op5_language_id")
    assert sorted(r.doc_id for r in got) == sorted(by_id)
    known = {d["lang"] for d in docs if d["lang"] and fold(d["doc_id"], 3) != 1}
    right = n = 0
    for r in got:
        d = by_id[r.doc_id]
        assert r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        assert r.lang_pred in known if langid.has_letter(d["text"]) else r.lang_pred == "und"
        if r.held_out and d["lang"] and langid.has_letter(d["text"]):
            n, right = n + 1, right + (r.lang_pred == d["lang"])
    assert right >= 0.95 * n


def test_op6(run, docs):
    encode, got, spots = tokens.encoder(), defaultdict(list), defaultdict(list)
    for r in run("op6_best_fit_packing"):
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        spots[r.sequence_id].append((r.offset, r.length))
    for d in docs:
        ids = [*encode(d["text"] or ""), 2]
        own = sorted(got.pop(d["doc_id"]))
        assert own == [(k, a, n, binascii.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, a, n, _ in own]
        assert sum(n for _, _, n, _ in own) == len(ids) and all(n == 1024 for _, _, n, _ in own[1:])
    assert not got
    for own in spots.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024


def test_op7(run, docs):
    got = {r.doc_id: r for r in run("op7_benchmark_decontamination")}
    assert {d["doc_id"]: len(decontam.words(d["text"])) for d in docs} == {i: r.n_words for i, r in got.items()}
    assert all(r.contaminated == (r.n_items >= 2) and (r.n_hit > 0) == (r.longest_at >= 0) for r in got.values())


def test_op8(run):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in run("op8_html_extraction")}
    assert set(got) == {p["page_id"] for p in pages}
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in got.values())
    assert {p["page_id"]: html_extract.main_text(p["html"], set()) for p in pages} == {i: r.text for i, r in got.items()}


def test_op9(run, docs):
    got = {r.doc_id: r for r in run("op9_quality")}
    assert set(got) == {d["doc_id"] for d in docs}
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())


def test_op10(run, docs):
    got = {r.doc_id: r for r in run("op10_personal_data")}
    for d in docs:
        base, r = pii.base_spans(d["text"] or ""), got[d["doc_id"]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) or not base
        assert r.n_spans == len(base) + r.n_added == len([x for x in r.spans.split(",") if x])
