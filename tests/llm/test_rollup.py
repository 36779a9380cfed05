from collections import Counter

from rulespark.llm import rollup, tokens

SCHEMA = "doc_id long, text string, source string, lang string, n_tokens string, n_docs int"
ROWS = [(1, "one two", "a", "en", "x", 0), (2, None, "a", "en", "x", 0), (3, "drei", None, "de", "x", 0), (3, "drei", None, "de", "x", 0), (None, "", "b", None, None, None)]


def expected(signed):
    encode, out = tokens.encoder(), Counter()
    docs = Counter()
    for sign, (_, text, source, lang, *_) in signed:
        out[source, lang] += sign * len(encode(text or ""))
        docs[source, lang] += sign
    return {k: (docs[k], out[k]) for k in docs if docs[k] or out[k]}


def held(totals):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in totals.totals().collect()}


def test_deltas_equal_a_recount(spark, tmp_path):
    totals = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert held(totals) == {}
    counted = lambda rows: rollup.count_tokens(spark.createDataFrame(rows, SCHEMA))
    assert totals.commit("b1", rollup.inserts(counted(ROWS)))
    assert held(totals) == expected([(1, r) for r in ROWS])
    assert not totals.commit("b1", rollup.inserts(counted(ROWS)))
    new = (1, "one two three", "a", "en", "x", 0)
    totals.commit("b2", rollup.revisions(counted(ROWS[:1]), counted([new])))
    totals.commit("b3", rollup.deletes(counted(ROWS[2:4])))
    want = expected([(1, r) for r in [new, ROWS[1], ROWS[4]]])
    assert held(totals) == want and ("b", None) in want and (None, "de") not in want
    totals.compact("all")
    assert held(totals) == want
    assert not totals.commit("b2", rollup.inserts(counted(ROWS)))


def test_a_broken_write_is_no_batch_and_can_be_retried(spark, tmp_path):
    totals = rollup.TokenRollup(spark, str(tmp_path / "r"))
    broken = tmp_path / "r" / "generation=0" / "data" / "b1~0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("cut off")
    assert totals.committed() == []
    counts = rollup.count_tokens(spark.createDataFrame(ROWS, SCHEMA))
    assert totals.commit("b1", rollup.inserts(counts))
    assert held(totals) == expected([(1, r) for r in ROWS])


def test_compaction_holds_for_every_process(spark, tmp_path):
    path = str(tmp_path / "r")
    first, counts = rollup.TokenRollup(spark, path), rollup.count_tokens(spark.createDataFrame(ROWS, SCHEMA))
    first.commit("b1", rollup.inserts(counts))
    (tmp_path / "r" / "generation=1" / "data" / "half").mkdir(parents=True)  # one that did not end
    other = rollup.TokenRollup(spark, path)
    assert held(other) == expected([(1, r) for r in ROWS])
    first.compact("c1")
    assert held(other) == expected([(1, r) for r in ROWS]) and other.committed() == ["b1", "c1"]
    assert not other.commit("b1", rollup.inserts(counts))
    assert other.commit("b2", rollup.deletes(counts)) and held(first) == {}
    first.compact("c2")
    assert held(other) == {} and other.committed() == ["b1", "b2", "c1", "c2"]


def test_long_texts_and_versions(spark):
    text = "one two " * 60_000
    df = spark.createDataFrame([(1, text, "a", "en", "x", 0), (2, "  ", None, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in rollup.count_tokens(df).collect()}
    assert got[1].n_tokens == len(tokens.encoder()(text)) and got[1].tokenizer_version == rollup.version()
    assert rollup.version().startswith("byte_bpe_50k.json@")
    assert {r.doc_id: r.n_tokens for r in rollup.count_words(df).collect()} == {1: 120_000, 2: 0}


def test_empty_table(spark, tmp_path):
    totals = rollup.TokenRollup(spark, str(tmp_path / "r"))
    totals.commit("b1", rollup.inserts(rollup.count_tokens(spark.createDataFrame([], SCHEMA))))
    assert held(totals) == {} and totals.committed() == ["b1"]
