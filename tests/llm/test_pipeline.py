import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rulespark.llm import decontam, langid, pii, simhash, tokens

SYLLABLES = {"en": "the ing and of er th".split(), "de": "sch ung lich für ein ge".split()}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    items = [(i, sentence(rnd, "en", 20)) for i in range(5)]
    rows = [(i, sentence(rnd, lang := rnd.choice(["en", "de"]), rnd.choice([8, 60, 400])), lang, f"s{i % 3}", 0) for i in range(80)]
    rows += [(100, None, "en", "s0", 0), (101, "12 34", "en", "s0", 0), (102, "", None, None, None)]
    rows += [(110 + k, rows[5][1], "en", "s1", 0) for k in range(4)] + [rows[7]]
    rows += [(120, f"{sentence(rnd, 'en', 30)} {items[0][1]} {sentence(rnd, 'en', 9)} {items[1][1]}", "en", "s1", 0)]
    rows += [(121, f"{sentence(rnd, 'en', 30)} {items[2][1]}", "en", "s1", 0)]
    rows += [(130, f"{sentence(rnd, 'en', 30)} a.b@example.org and +1 (269) 555-3296 4524132264652876 {sentence(rnd, 'en', 30)}", "en", "s1", 0)]
    rows += [(None, sentence(rnd, "en", 50), None, None, None)]
    root = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, items


def test_each_stage_does_its_work(spark, corpus):
    root, rows, items = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.materialize(stage(spark, before, root), name)
        out[name] = docs.collect()
        if name != cp.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    kept = {r.doc_id for r in out["language_id"]}
    assert kept == {r[0] for r in rows if langid.has_letter(r[1])}
    stage2 = [r.doc_id for r in out["simhash_near_dedup"]]
    assert len(set(stage2)) == len(stage2) and not {110, 111, 112, 113} & set(stage2) and 5 in stage2
    prints = {simhash.fingerprint(r.text) for r in out["language_id"]}
    left = {simhash.fingerprint(r.text) for r in out["simhash_near_dedup"]}
    assert left <= prints
    assert {r.doc_id for r in out["simhash_near_dedup"]} - {r.doc_id for r in out["benchmark_decontamination"]} == {120}
    cleaned = {r.doc_id: r for r in out["personal_data"]}
    assert "[EMAIL] and [PHONE] [CARD]" in cleaned[130].text and cleaned[130].n_chars == len(cleaned[130].text)
    assert all(not pii.base_spans(r.text) for r in cleaned.values())
    packed = out["best_fit_packing"]
    assert {r.doc_id for r in packed} == set(cleaned)
    encode = tokens.encoder()
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) + 1 for r in cleaned.values())
    words = decontam.words(cleaned[121].text)
    assert len(words) > 40


def test_run_applies_all_stages(spark, corpus):
    root, *_ = corpus
    got = cp.run(spark, root)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(got.columns)
    assert not {120, 110, 100, 101, 102} & {r.doc_id for r in got.collect()}


def test_odd_rows_have_the_results_stated(spark, corpus, tmp_path):
    _, rows, items = corpus
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = " ".join(rows[3][1].split()[:8])
    hit = f"{items[0][1]} {items[1][1]}"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", "en", "s", 3), (None, plain, "en", None, 9), (None, plain, "en", None, 9),
           (4, hit, "en", "s", 9), (4, hit, "en", "s", 9), (None, hit, None, None, None), (5, "a.b@example.org " + "plain words " * 300_000, "en", "s", 1)]
    docs = spark.createDataFrame(odd, schema)
    spark.createDataFrame([*items, items[0], (None, items[2][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda stage: stage(spark, docs, str(tmp_path)).collect()
    ids = lambda got: sorted((r.doc_id for r in got), key=str)

    assert {r.doc_id for r in run(cp.language_id)} == {None, 4, 5} and len(run(cp.language_id)) == 6
    assert ids(run(cp.near_duplicates)) == [1, 4, 5, None]
    assert ids(run(cp.decontamination)) == [1, 2, 3, 5, None, None]
    cleaned = run(cp.personal_data)
    assert ids(cleaned) == ids(docs.collect())
    assert {r.doc_id: r.n_chars for r in cleaned if r.doc_id in (1, 2, 3)} == {1: None, 2: 0, 3: 2}
    (long,) = (r.text for r in cleaned if r.doc_id == 5)
    assert long.startswith("[EMAIL] plain words") and len(long) > 3_000_000
    packed = run(cp.packing)
    assert sum(r.doc_id == 1 for r in packed) == 1 and sum(r.piece == 0 for r in packed) == len(odd)

    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert cp.language_id(spark, unlabelled, str(tmp_path)).count() == 0
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert cp.decontamination(spark, docs, f"{tmp_path}/none").count() == len(odd)


def test_empty_tables(spark, corpus, tmp_path):
    root, *_ = corpus
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
